import math

import numpy as np
import pytest

from roamer.operators import clustering, ev, graph, segment, tripdist


def fold(points, **kw):
    f = segment.Fold(**({"gap": 1200, "stop_km": 0.05, "max_speed": 0.07} | kw))
    out = [d for p in points if (d := f.add(p))]
    if kept := f.finished():
        out.append((f.tid, kept))
    return out


def p(metres_north, t):
    return (11.0, 43.0 + metres_north / 111_000, t)


def test_one_point_is_no_trip():
    assert fold([p(0, 0)]) == []


def test_jump_is_dropped():
    (_, trip), = fold([p(0, 0), p(100, 10), p(90_000, 20), p(200, 30)])
    assert [x[2] for x in trip] == [0, 10, 30]


def test_long_gap_starts_a_trip_where_the_last_ended():
    (a, one), (b, two) = fold([p(0, 0), p(100, 10), p(200, 20), p(900, 5000), p(1200, 5100), p(1500, 5200)])
    assert (a, b) == (0, 1) and len(one) == 3
    assert two[0][:3] == (*p(200, 0)[:2], 5000) and two[1][2] == 5050
    assert two[1][3] == 0 and two[2][3] > 0  # the artificial first hop has no length


def test_numbers_have_gaps_where_nothing_was_kept():
    assert [tid for tid, _ in fold([p(0, 0), p(100, 10), p(0, 5000), p(5000, 10000), p(5100, 10010)])] == [0, 2]


def test_t_quantile():
    assert segment.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert segment.t_quantile(0.95, 1) == pytest.approx(6.3137515, abs=1e-5)
    assert segment.t_quantile(0.5, 5) == pytest.approx(0, abs=1e-9)


def test_outlier_rules():
    data = np.array([10.0, 11, 9, 10, 12, 8, 10, 11])
    assert segment.thompson(data, 100) and not segment.thompson(data, 10)
    assert segment.chauvenet(data, 10) and not segment.chauvenet(data, 100)
    assert segment.quartile_outlier(data, 100) and not segment.quartile_outlier(data, 10)


def test_linkage_and_medoid():
    lon, lat = np.array([11.0, 11.0001, 11.1, 11.1001]), np.full(4, 43.0)
    assert clustering.linked_within(lon, lat, 200).tolist() == [0, 0, 2, 2]
    d = np.abs(np.subtract.outer([0.0, 1, 3, 7], [0.0, 1, 3, 7]))
    assert clustering.linkage_heights(d).tolist() == [1, 2, 4]
    assert clustering.medoid(np.array([[0.0, 0], [1, 0], [5, 0]])) == 1


def test_tosca_finds_separated_places():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(0, 5, (20, 2)) for c in np.array([[0, 0], [5000, 0], [0, 9000]])])
    assert len(clustering.tosca(x, 50, np.random.default_rng(2))) == 3


def test_trip_distance():
    a = [(11.0, 43.0, 0), (11.01, 43.0, 60), (11.02, 43.0, 120)]
    assert tripdist.synchronised(a, a) == 0
    b = [(x, y + 0.001, t) for x, y, t in a]
    assert 100 < tripdist.synchronised(a, b) < 400
    assert tripdist.inclusion(a, a[:2], 10) == pytest.approx(0, abs=1e-6) and tripdist.inclusion(a, b, 10) == math.inf
    assert tripdist.inclusion_in_time(a, a, 10, 60)["total"] == pytest.approx(0, abs=1e-6)


def test_graph_metrics():
    m = graph.graph_metrics([(0, 1), (1, 2), (2, 0)])
    assert m["avg_clustering"] == 1 and m["diameter"] == 1
    assert graph.graph_metrics([(0, 0)])["diameter"] == 0
    line = graph.graph_metrics([(0, 1), (1, 2)])
    assert line["max_betweenness"] == 0.5 and line["diameter"] == 2


def brute(graph_, s):
    dist = {s: 0.0}
    for _ in range(len(graph_) + 1):
        for u in list(dist):
            for v, w, _ in graph_.get(u, ()):
                dist[v] = min(dist.get(v, math.inf), dist[u] + w)
    return dist


def test_routes_equal_relaxation():
    rng = np.random.default_rng(3)
    g = {u: [(int(v), float(rng.integers(1, 20)), float(rng.integers(-3, 9))) for v in rng.integers(0, 30, 3)] for u in range(30)}
    for s in range(5):
        sec, _, before = ev.search(g, s)
        assert sec == pytest.approx(brute(g, s))
        for t in sec:
            way = ev.way(before, s, t)
            assert way[0] == s and way[-1] == t


def test_battery_bounds_routes():
    g = {0: [(1, 1.0, 5.0)], 1: [(2, 1.0, 5.0)]}
    assert set(ev.search(g, 0, 8, 10, 0.1)[0]) == {0, 1}
    assert set(ev.search(g, 0, 12, 12, 0.1)[0]) == {0, 1, 2}


def test_clusters_draw_as_choice_does_and_quantiles_are_kept():
    x = np.random.default_rng(5).normal(size=(200, 2))
    a, b = np.random.default_rng(9), np.random.default_rng(9)
    seeds = clustering.seeded(x, 6, a)
    chosen = [int(b.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(5):
        chosen.append(int(b.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    assert np.array_equal(seeds, x[chosen]) and a.random() == b.random()
    segment.t_quantile(0.975, 9)
    hits = segment.t_quantile.cache_info().hits
    assert abs(segment.t_quantile(0.975, 9) - 2.262157) < 1e-5 and segment.t_quantile.cache_info().hits == hits + 1
