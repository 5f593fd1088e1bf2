import math

import numpy as np
import pytest

from corpuslens.operators import difficulty, fidelity, gates, panels, preprocess, sampling, structure
from corpuslens.operators import generator as G
from corpuslens.operators import knn as K
from corpuslens.sources import matrices


def frame(spark, x, series=None):
    rows = [(i, [float(y) for y in v], series[i] if series else "real") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, series string")


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k]
        out[i] = [(j, d[i, j]) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 3, 100])
def test_knn_with_ties_and_copies(spark, k):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((30, 4)), np.eye(4), np.eye(4), np.zeros((3, 4)), rng.integers(0, 2, (40, 4))])
    got = {}
    for r in K.knn(frame(spark, x), k).orderBy("q", "rk").collect():
        got.setdefault(r.q, []).append((r.t, r.d))
    want = brute_knn(x, k)
    assert {q: [t for t, _ in v] for q, v in got.items()} == {q: [t for t, _ in v] for q, v in want.items()}
    assert np.allclose([d for v in got.values() for _, d in v], [d for q in got for _, d in want[q]])
    assert all(q not in [t for t, _ in v] for q, v in got.items())


def test_knn_needs_two_points(spark):
    with pytest.raises(ValueError):
        K.knn(frame(spark, [[1.0, 2.0]]), 1)


def test_all_tied_points_have_no_dimension(spark):
    s = difficulty.summary(frame(spark, np.eye(12)), k=5).first()
    assert (s.lid_median, s.relative_contrast_median, s.lid_discarded_queries, s.ann_k) == (None, None, 12, 5)


def test_dimension_of_a_ball(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 4))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0, 1, (4000, 1)) ** 0.25
    s = difficulty.summary(frame(spark, x), k=100).first()
    assert 3.2 < s.lid_median < 4.8
    assert 3 < structure.two_nn(frame(spark, x)).first().dimension < 5


def test_occurrence_counts_all(spark):
    df = frame(spark, np.random.default_rng(2).standard_normal((200, 8)))
    n = difficulty.k_occurrence(df, K.knn(df, 20), 10).collect()
    assert len(n) == 200 and sum(r.n for r in n) == 2000


@pytest.mark.parametrize(("counts", "want"), [([5, 5, 5, 5], 0), ([0, 0, 0, 20], 0.75), ([0, 0, 0], 0)])
def test_gini(spark, counts, want):
    cells = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "cell int, n long")
    assert difficulty.gini(cells).first().gini == pytest.approx(want)


def test_skew_without_spread(spark):
    assert spark.createDataFrame([(4,)] * 4, "n long").agg(difficulty.skew("n")).first()[0] == 0


def test_samples(spark):
    df = frame(spark, np.arange(1000).reshape(-1, 1))
    ids = [r.vec_id for r in sampling.sample(df, 50, 42).collect()]
    assert len(set(ids)) == 50 and max(ids) > 500
    assert sorted(ids) == sorted(r.vec_id for r in sampling.sample(df.repartition(7), 50, 42).collect())
    assert sampling.sample(df, 0, 1).count() == 1000
    split = sampling.holdout_split(df, 0.0025, 42)
    assert split.where("is_holdout").count() == 2  # half to even
    with pytest.raises(ValueError):
        sampling.disjoint_draws(df, 4, 300, 1)
    draws = sampling.disjoint_draws(df, 3, 300, 1)
    assert draws.count() == draws.select("vec_id").distinct().count() == 900
    assert sorted(r.rn for r in sampling.ranked(df, 3).collect()) == list(range(1, 1001))
    assert sampling.variant_seed(0, "v0") == sampling.variant_seeds(spark.createDataFrame([("v0",)], "name string"), 0).first().seed


def test_covariances_of_far_points(spark):
    x = np.random.default_rng(4).standard_normal((300, 5)) + 1e6
    c, mean, n = fidelity.covariances(frame(spark, x).repartition(4))["real"]
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x.T), rtol=1e-6)


def test_whitening_and_back(spark):
    x = np.random.default_rng(5).standard_normal((200, 4)) @ np.diag([1, 2, 3, 4]) + 7
    df = frame(spark, x)
    state = preprocess.fit(df, preprocess.Settings(center=True, whiten=True, l2_normalize=False))
    state = preprocess.State.from_json(state.to_json())
    white = preprocess.apply(df, state)
    y = np.array([r.v for r in white.orderBy("vec_id").collect()])
    assert np.allclose(np.cov(y.T), np.eye(4), atol=1e-6)
    assert np.allclose([r.v for r in preprocess.invert(white, state).orderBy("vec_id").collect()], x)
    lost = preprocess.State(4, preprocess.Settings(center=True), [0.0] * 4)
    with pytest.raises(ValueError):
        preprocess.invert(df, lost)
    with pytest.raises(ValueError):
        preprocess.Settings(metric="dot")


@pytest.mark.parametrize("center", [False, True])
@pytest.mark.parametrize("whiten", [False, True])
def test_every_transform_comes_back(spark, center, whiten):
    x = np.random.default_rng(6).standard_normal((150, 5)) @ np.diag([1, 2, 3, 4, 9]) + 3
    df = frame(spark, x)
    state = preprocess.fit(df, preprocess.Settings(center=center, whiten=whiten, l2_normalize=False))
    assert (state.mean is None) == (not center) and (state.matrix is None) == (not whiten)
    back = preprocess.invert(preprocess.apply(df, state), state)
    assert np.allclose([r.v for r in back.orderBy("vec_id").collect()], x)


def test_directions_of_whitened_rows_come_back(spark):
    """Whitened without centring, then divided by their norms: each row comes back but for a factor."""
    x = np.random.default_rng(7).standard_normal((200, 6)) * [1, 2, 3, 4, 5, 6]
    state = preprocess.fit(frame(spark, x), preprocess.Settings(whiten=True))
    assert preprocess.inversion_blocker(state) is None
    y = np.array([r.v for r in preprocess.invert(preprocess.apply(frame(spark, x), state), state).orderBy("vec_id").collect()])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert np.allclose(unit(y), unit(x))
    lost = preprocess.fit(frame(spark, x), preprocess.Settings(whiten=True, center=True))
    with pytest.raises(ValueError):
        preprocess.invert(frame(spark, x), lost)


def test_column_major_files(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(8).standard_normal((77, 5)).astype(np.float32)
    for name, kind in (("f4", "<f4"), ("f8", "<f8")):
        np.save(tmp_path / f"rows_{name}.npy", x.astype(kind))
        np.save(tmp_path / f"columns_{name}.npy", np.asfortranarray(x.astype(kind)))
        for split in (1 << 25, 100):
            monkeypatch.setattr(matrices, "SPLIT", split)
            a, b = (sorted((r.vec_id, tuple(r.v)) for r in matrices.load(spark, str(tmp_path / f"{o}_{name}.npy")).collect()) for o in ("rows", "columns"))
            assert a == b and len(a) == 77 and np.allclose([v for _, v in b], x)
    np.save(tmp_path / "empty.npy", np.asfortranarray(np.zeros((0, 3), np.float32)))
    assert matrices.load(spark, str(tmp_path / "empty.npy")).count() == 0


def test_files_are_written_at_their_places(spark, tmp_path):
    from pyspark.sql import functions as F

    x = np.random.default_rng(9).standard_normal((5000, 3)).astype(np.float32)
    order = np.random.default_rng(1).permutation(5000)
    df = spark.createDataFrame([(int(i) * 3 - 999, [float(a) for a in x[i]]) for i in order], "vec_id long, v array<double>").repartition(7)
    assert matrices.write_npy(df, str(tmp_path / "a.npy")) == matrices.write_fvecs(df, str(tmp_path / "a.fvecs")) == 5000
    np.save(tmp_path / "b.npy", x)
    assert (tmp_path / "a.npy").read_bytes() == (tmp_path / "b.npy").read_bytes()
    rows = np.frombuffer((tmp_path / "a.fvecs").read_bytes(), "<i4").reshape(-1, 4)
    assert (rows[:, 0] == 3).all() and (rows[:, 1:].copy().view("<f4") == x).all()
    assert matrices.write_npy(df.where("false"), str(tmp_path / "none.npy")) == 0 and np.load(tmp_path / "none.npy").shape == (0, 0)
    # A task that fails leaves nothing, neither a file nor a part of one.
    bad = df.withColumn("v", F.when(F.col("vec_id") == 300, F.array(F.raise_error(F.lit("lost")).cast("double"), F.lit(1.0), F.lit(1.0))).otherwise(F.col("v")))
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(Exception, match="lost"):
        matrices.write_npy(bad, str(tmp_path / "c.npy"))
    with pytest.raises(ValueError):
        matrices.write_npy(df.withColumn("v", F.when(F.col("vec_id") == 300, F.array(F.lit(1.0))).otherwise(F.col("v"))), str(tmp_path / "c.npy"))
    assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_only_row_groups_with_drawn_rows_are_read(spark, tmp_path):
    """All other row groups hold rubbish, which nothing could read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "0.parquet")
    pq.write_table(pa.table({"openai": pa.array([[float(k)] * 4 for k in range(1000)], pa.list_(pa.float32())), "text": ["t"] * 1000}), path, row_group_size=50)
    drawn = {r.vec_id for r in matrices.sample_shards(spark, [path], 5).collect()}
    footer = pq.ParquetFile(path).metadata
    data, hit = bytearray((tmp_path / "0.parquet").read_bytes()), {i // 50 for i in drawn}
    for g in set(range(20)) - hit:
        c = footer.row_group(g).column(0)
        at = c.dictionary_page_offset or c.data_page_offset
        data[at : at + c.total_compressed_size] = bytes([255]) * c.total_compressed_size
    (tmp_path / "0.parquet").write_bytes(data)
    assert 1 < len(hit) <= 5 and {r.vec_id: r.v for r in matrices.sample_shards(spark, [path], 5).collect()} == {i: [float(i)] * 4 for i in drawn}
    with pytest.raises(Exception):
        matrices.sample_shards(spark, [path], 1000).count()


def test_unit_norm(spark):
    x = np.random.default_rng(6).standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] = 0
    structure.require_unit_norm(frame(spark, x))
    x[17] *= 0.5
    with pytest.raises(ValueError, match="1 of 60"):
        structure.require_unit_norm(frame(spark, x))


def test_spread_and_floor(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("c", -1.0), ("c", 1.0)], "statistic string, value double")
    got = {r.statistic: r for r in structure.spread(values).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"]["mean"], got["a"]["std"], got["a"].range_pct, got["a"].cv_pct) == (2, 1, 100, 50)
    assert got["c"].range_pct is None


GATE = "canonical: {n: 1, k: 1, k_hub: 1, nlist: 1}\nstatistics: {lid_median: %s, relative_contrast_median: null, hubness_skew: null, ivf_gini: null}"


@pytest.mark.parametrize("text", ["[", "- 1", "canonical: {n: 1}", GATE % "{low: 1}", GATE % "{min: 3, max: 1}", GATE % "{min: .nan}", GATE % "{min: true}", GATE.replace("n: 1", "n: 0", 1) % "null", GATE.replace("k_hub: 1", "hub: 1") % "null"])
def test_bad_gates_are_refused(text):
    with pytest.raises(gates.GateError):
        gates.load_gate(text)


def test_outcomes(spark):
    bands = gates.bands(spark, gates.load_gate(GATE % "{min: 8, max: 16}"))
    def outcome(x):
        values = spark.createDataFrame([("lid_median", x)], "statistic string, value double")
        return {r.statistic: r.outcome for r in gates.check_statistics(values, bands).collect()}["lid_median"]
    assert [outcome(x) for x in (8.0, 16.0, 7.9, 16.1, None, math.nan)] == ["pass", "pass", "fail", "fail", "fail", "fail"]


def test_manifests():
    good = "variants: [{name: a, config: c, run_dir: r}, {name: b, config: c, run_dir: r}]"
    assert [v["name"] for v in gates.load_variants(good)] == ["a", "b"]
    for bad in ("x: 1", "variants: []", "variants: [{name: a}]", good.replace("name: b", "name: a")):
        with pytest.raises(gates.GateError):
            gates.load_variants(bad)
    assert gates.entry({"stats": [{"name": "real", "x": 1}]}, "real")["x"] == 1
    with pytest.raises(gates.GateError):
        gates.entry({"stats": []}, "real")
    for bad in (True, "1", None, math.inf):
        with pytest.raises(gates.GateError):
            gates.strict_value({"x": bad}, "x")


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((120, 8)).astype(np.float32)
    np.save(tmp_path / "a.npy", x)
    with open(tmp_path / "a.fvecs", "wb") as f:
        for row in x:
            f.write(np.int32(8).tobytes() + row.tobytes())
    for name in ("a.npy", "a.fvecs"):
        df = matrices.load(spark, str(tmp_path / name))
        rows = df.orderBy("vec_id").collect()
        assert [r.vec_id for r in rows] == list(range(120)) and np.array_equal(np.array([r.v for r in rows], np.float32), x)
    assert matrices.write_fvecs(matrices.load(spark, str(tmp_path / "a.npy")), str(tmp_path / "b.fvecs")) == 120
    assert (tmp_path / "b.fvecs").read_bytes() == (tmp_path / "a.fvecs").read_bytes()
    np.save(tmp_path / "flat.npy", x[0])
    (tmp_path / "empty.fvecs").write_bytes(b"")
    (tmp_path / "short.fvecs").write_bytes((tmp_path / "a.fvecs").read_bytes()[:-1])
    for bad in ("flat.npy", "empty.fvecs", "short.fvecs"):
        with pytest.raises(Exception):
            matrices.load(spark, str(tmp_path / bad)).count()
    with pytest.raises(ValueError):
        matrices.load(spark, "x.csv")
    a = [r.v for r in matrices.synthetic(spark, 20, 3).orderBy("vec_id").collect()]
    assert a == [r.v for r in matrices.synthetic(spark, 20, 3).repartition(5).orderBy("vec_id").collect()]


def test_gated_generator_gives_exact_zeros(spark):
    layers = lambda s: G.random_layers([8, 128], s)[0]
    network = G.build("structured_gate", trunk=G.random_layers([4, 8], 1), sizes=layers(2), gates=layers(3), kernel=np.full((3, 3, 3), 1 / 27))
    v = np.array([r.v for r in G.generate(spark, network, 50, 4, 128).collect()])
    assert v.shape == (50, 128) and (v >= 0).all() and 0.1 < (v == 0).mean() < 0.9
    with pytest.raises(ValueError):
        G.build("none")


def test_log_ratio_penalty_and_ema(spark):
    a = spark.createDataFrame([(1, -1.0), (2, -0.5)], "rk long, profile double")
    b = spark.createDataFrame([(1, -1.5), (2, -0.25)], "rk long, profile double")
    assert fidelity.log_ratio_penalty(a, b).first().penalty == pytest.approx(0.75)
    x = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 3.0)], "key string, step long, x double")
    assert [r.ema for r in fidelity.ema(x, 0.5).orderBy("step").collect()] == [1.0, 2.0]


def test_report_drops_what_does_not_apply(spark):
    x = np.random.default_rng(8).standard_normal((60, 4))
    config = panels.Config(k=10, k_hub=5, rows=60, nlist=8, pairs=100, bins=5)
    both = panels.report(panels.Context(frame(spark, x, ["real", "synth"] * 30), config))
    assert "norms" not in both and "mismatch" in both and both["lid"].count() > 0
    assert "mismatch" not in panels.report(panels.Context(frame(spark, x), config))


def test_w1_orders_shifted_dimensions(spark):
    x = np.random.default_rng(9).standard_normal((200, 3))
    y = x + [9, 0, 5]
    df = frame(spark, np.concatenate([x, y]), ["real"] * 200 + ["synth"] * 200)
    assert [r.dim for r in fidelity.dimension_divergence(df, 2).orderBy("ord").collect()] == [0, 2]


def test_the_average_of_all_events(spark):
    """ema_target takes every event, and folds a long key in a stream; against a plain loop."""
    import duckdb

    from corpuslens.plans import registry

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select event_type, value from '{sf}/events.parquet' order by event_id").fetchall()
    now, n, total, want = {}, {}, {}, {}
    for key, x in rows:
        n[key], total[key] = n.get(key, 0) + 1, total.get(key, 0.0) + x
        mean = total[key] / n[key]
        now[key] = now[key] * 0.99 + mean * (1 - 0.99) if key in now else mean
        want[key, n[key]] = now[key]
    got = {(r.key, r.step): r.ema for r in registry.QUERIES["ema_target"](spark, sf).collect()}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_averages_of_several_keys_and_nulls(spark):
    x = spark.createDataFrame([("a", 2, 3.0), (None, 1, 5.0), ("a", 1, None), ("a", 3, 5.0), ("b", 1, 7.0), ("a", 4, None)], "key string, step long, x double")
    got = {(r.key, r.step): r.ema for r in fidelity.ema(x, 0.5).collect()}
    assert got == {("a", 1): None, ("a", 2): 3.0, ("a", 3): 4.0, ("a", 4): 4.0, ("b", 1): 7.0, (None, 1): 5.0}


def test_penalty_scale_against_numpy(spark):
    from hashlib import md5

    x = np.random.default_rng(3).standard_normal((90, 4))
    series = ["real"] * 60 + ["synth"] * 30

    def profile(rows):
        logs = []
        for i in rows:
            d = sorted(math.dist(x[i], x[j]) for j in rows if j != i)[:5]
            logs.append([math.log(y / d[-1]) for y in d[:-1]])
        return np.mean(logs, 0)

    average, floors, signals = None, [], []
    for t in range(8):
        order = sorted(range(90), key=lambda i: md5(f"42:{t}:{i}".encode()).hexdigest())
        real, synth = ([i for i in order if series[i] == s] for s in ("real", "synth"))
        a = profile(real[:20][:15])
        average = a if average is None else 0.99 * average + 0.01 * a
        floors.append(abs(profile(real[20:40][:15]) - average).sum())
        signals.append(abs(profile(synth[:20][:15]) - average).sum())
    got = structure.penalty_scale(frame(spark, x, series), 20, 8, 5, 15, adv_loss=-2.0).first()
    f, s = np.array(floors[2:]), np.array(signals[2:])
    assert list(got) == pytest.approx([6, f.mean(), f.std(), s.mean(), s.std(), s.mean() / f.mean(), 0.05 * 2 / s.mean()])


def test_penalty_scale_copies_few_rows(spark, monkeypatch):
    """Of a larger table each trial takes its rows from its own window; every trial has enough."""
    x = np.random.default_rng(3).standard_normal((6000, 3))
    df = frame(spark, x, ["real" if i % 2 else "synth" for i in range(6000)]).repartition(4)
    sizes = []
    profile = structure._penalties
    monkeypatch.setattr(structure, "_penalties", lambda trials, decay: sizes.append(list(trials)) or profile(sizes[-1], decay))
    got = structure.penalty_scale(df, 8, 20, 5, 0).first()
    assert got.trials == 15 and all(a is not None and len(a) == 4 == len(b) for part in sizes for a, b in part)


@pytest.mark.parametrize(("size", "step"), [(500.0, 1e-6), (1e5, 1e-3), (1.0, 1e-9)])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_of_close_rows_with_large_norms(spark, size, step, metric):
    rng = np.random.default_rng(11)
    far = np.full(8, size / math.sqrt(8))
    x = far + step * rng.integers(-40, 40, (300, 8))
    got = {}
    for r in K.knn(frame(spark, x), 5, metric).orderBy("q", "rk").collect():
        got.setdefault(r.q, []).append((r.t, r.d))
    for q in range(300):
        d = K._exact(metric, x[q][None], x[None])[0]
        d[q] = np.inf
        assert got[q] == [(j, d[j]) for j in sorted(range(300), key=lambda j: (d[j], j))[:5]]


def test_distances_of_close_rows_with_large_norms():
    rng = np.random.default_rng(12)
    x = 500 + 1e-6 * rng.integers(0, 50, (60, 64))
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(K.distances(x, x), want, rtol=1e-6, atol=0)
    y = rng.standard_normal((50, 16))
    assert np.allclose(K.distances(y, y), np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), rtol=1e-6, atol=0)


def test_knn_among_many_copies_in_bounded_memory():
    """20,000 copies of a wide row: one block of queries stays within what its distances take."""
    import tracemalloc
    import pyarrow as pa

    rng = np.random.default_rng(13)
    v = np.concatenate([np.repeat(rng.standard_normal((1, 256)), 20_000, 0), rng.standard_normal((500, 256))])
    ids = np.arange(len(v))
    block = K.Block(pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 256))
    run = K._nearest(10, "l2", True)
    tracemalloc.start()
    q, rk, t, d = run(ids[:200], v[:200], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    assert (d == 0).all() and t.reshape(200, 10)[0].tolist() == list(range(1, 11)) and t.reshape(200, 10)[50].tolist() == list(range(10))


def test_covariances_meet_on_the_executors(spark):
    x = np.random.default_rng(14).standard_normal((400, 6)) * [1, 2, 3, 4, 5, 6] + 10
    series = ["real"] * 250 + ["synth"] * 150
    df = frame(spark, x, series).repartition(7)
    for centred in (True, False):
        got = fidelity.covariances(df, 1, centred)
        for s, part in (("real", x[:250]), ("synth", x[250:])):
            want = np.cov(part.T) if centred else part.T @ part / (len(part) - 1)
            assert got[s][2] == len(part) and np.allclose(got[s][0], want) and np.allclose(got[s][1], part.mean(0))


def test_gated_rows_are_of_unit_norm_and_never_zero(spark):
    rng = np.random.default_rng(15)
    layers = lambda s: G.random_layers([8, 128], s)[0]
    for gate_bias, size_bias in ((0.0, 0.0), (-1e3, 0.0), (0.0, -1e4), (-1e3, -1e4)):
        gates_, sizes = layers(3), layers(2)
        network = G.build("structured_gate", trunk=G.random_layers([4, 8], 1), sizes=(sizes[0], sizes[1] + size_bias), gates=(gates_[0], gates_[1] + gate_bias), kernel=np.full((3, 3, 3), 1 / 27))
        v = network(rng.standard_normal((40, 4)), rng.uniform(0, 1, (40, 128)))
        assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v >= 0).all()
        if gate_bias:
            assert ((v > 0).sum(1) <= 2).all()  # all gates are closed but for the rescued one, or a lucky one
    rows = G.generate(spark, G.Mlp(G.random_layers([4, 6], 5)), 20, 4, 6).collect()
    assert np.allclose([np.linalg.norm(r.v) for r in rows], 1, atol=1e-6)


def test_a_draw_without_a_statistic_is_an_error(spark):
    stats = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "statistic string, value double")
    with pytest.raises(ValueError, match="a"):
        structure.draw_floor(stats)


def test_npy_files_and_fvecs_samples(spark, tmp_path):
    x = np.random.default_rng(16).standard_normal((50, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<float>").repartition(4)
    assert matrices.write_npy(df, str(tmp_path / "x.npy")) == 50 and np.array_equal(np.load(tmp_path / "x.npy"), x)
    matrices.write_fvecs(df, str(tmp_path / "x.fvecs"))
    assert matrices.sample_fvecs(spark, str(tmp_path / "x.fvecs"), str(tmp_path / "s.npy"), 20) == 20
    drawn = np.load(tmp_path / "s.npy")
    assert drawn.shape == (20, 5) and len({tuple(r) for r in drawn} & {tuple(r) for r in x}) == 20
    for n in (0, 51):
        with pytest.raises(ValueError):
            matrices.sample_fvecs(spark, str(tmp_path / "x.fvecs"), str(tmp_path / "s.npy"), n)
    with pytest.raises(ValueError):
        matrices.write_npy(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, v array<float>"), str(tmp_path / "bad.npy"))


def test_samples_across_shards(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths, at = [], 0
    for i, n in enumerate((30, 20, 50)):
        rows = [[float(k)] * 4 for k in range(at, at + n)]
        pq.write_table(pa.table({"openai": pa.array(rows, pa.list_(pa.float32())), "text": ["t"] * n}), tmp_path / f"{i}.parquet")
        paths.append(str(tmp_path / f"{i}.parquet"))
        at += n
    got = matrices.sample_shards(spark, paths, 40).collect()
    assert len({r.vec_id for r in got}) == 40 and all(r.v == [float(r.vec_id)] * 4 for r in got)
    assert len({0 if r.vec_id < 30 else 1 if r.vec_id < 50 else 2 for r in got}) == 3
    assert matrices.sample_shards(spark, paths, 1000).count() == 100
    few = {r.vec_id for r in matrices.sample_shards(spark, paths, 1).collect()}
    assert len(few) == 1


def test_runs_that_cannot_be_brought_back():
    moved, plain = "data: {preprocess: {whiten: true}}", "data: {preprocess: {l2_normalize: true}}"
    state = '{"preprocess_state": {"descriptor_dim": 1, "mean": [1.0], "whitening_matrix": [[2.0]], "config": {"whiten": true, "l2_normalize": %s, "unknown": 1}}}'
    assert preprocess.run_blocker(plain, None) is None and preprocess.run_blocker("", None) is None
    assert preprocess.run_blocker(moved, state % "false") is None
    for metadata in (None, "{", "{}", '{"preprocess_state": {"mean": null}}', state % "true"):
        assert preprocess.run_blocker(moved, metadata)


def test_configurations_with_changes():
    base = {"seed": 1, "training": {"alpha": 0.1, "steps": 5}, "output_dir": "x"}
    assert gates.with_changes(base, {"seed": 2, "training.alpha": 0.5}, "runs/a") == {"seed": 2, "training": {"alpha": 0.5, "steps": 5}, "output_dir": "runs/a"}
    assert base["training"]["alpha"] == 0.1
    with pytest.raises(gates.GateError):
        gates.with_changes(base, {"training.beta": 1}, "x")


def test_scatter_against_numpy(spark):
    x = np.random.default_rng(17).standard_normal((200, 6)) @ np.diag([5, 3, 1, 1, 1, 1]) + 4
    got = np.array([[r.x, r.y] for r in panels.scatter(frame(spark, x)).orderBy("vec_id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(1)])[:, None]
    assert np.allclose(got, (x - x.mean(0)) @ axes.T)


def test_histograms_of_what_hardly_varies(spark):
    rows = [("a", 1.0 + i * 1e-9) for i in range(50)] + [("b", float(i)) for i in range(50)]
    got = panels.steady_histogram(spark.createDataFrame(rows, "series string, x double"), 10).collect()
    assert len([r for r in got if r.series == "a"]) == 1 and len([r for r in got if r.series == "b"]) == 10
    with pytest.raises(ValueError, match="b"):
        panels.steady_histogram(spark.createDataFrame([*rows, ("b", math.nan)], "series string, x double"), 10)
