import json

import numpy as np
import pytest

from corpuslens.operators import gates, panels
from corpuslens.plans import reports
from corpuslens.streaming.ema import ema


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(0)
    np.save(d / "real.npy", rng.standard_normal((200, 8)).astype(np.float32))
    np.save(d / "a.npy", rng.standard_normal((60, 8)).astype(np.float32))
    np.save(d / "b.npy", rng.standard_normal((60, 6)).astype(np.float32))
    return d


def test_files_are_compared(spark, files, tmp_path):
    m = reports.evaluate_files(spark, f"{files}/real.npy", f"{files}/a.npy", str(tmp_path), holdout_fraction=0.2)
    assert m["num_samples_used"] == 40 and all(np.isfinite(x) for x in m.values()) and len(m) == 8
    assert json.load(open(tmp_path / "metrics.json")) == m


def test_differing_dimensions_leave_no_file(spark, files, tmp_path):
    with pytest.raises(ValueError):
        reports.evaluate_files(spark, f"{files}/real.npy", f"{files}/b.npy", str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_report_gate_and_floor(spark, files, tmp_path):
    config = panels.Config(k=10, k_hub=5, rows=60, nlist=8, pairs=200, bins=8, top=4)
    s = reports.eda_report(spark, f"{files}/real.npy", str(tmp_path), [f"x={files}/a.npy"], config)
    assert [x["name"] for x in s["stats"]] == ["real", "x"] and len(s["worst_dimensions"]["x"]) == 4
    assert json.load(open(tmp_path / "summary.json"))["stats"][0]["ann_measured_rows"] == 60
    assert "<h2>lid</h2>" in (tmp_path / "report.html").read_text()
    gate = "canonical: {n: 60, k: 10, k_hub: 5, nlist: 8}\nstatistics: {lid_median: {min: 0}, relative_contrast_median: {min: 1}, hubness_skew: null, ivf_gini: {max: 0}}"
    got = reports.check_gate(spark, gate, s)
    assert (got["verdict"], got["exit_code"], got["statistics"]["hubness_skew"], got["statistics"]["ivf_gini"]) == ("fail", 1, "unset", "fail")
    assert reports.check_gate(spark, gate.replace("{max: 0}", "{max: 1}"), s)["exit_code"] == 2
    assert reports.check_gate(spark, gate.replace("{max: 0}", "{max: 1}"), s, allow_unset=True)["exit_code"] == 0
    assert reports.check_gate(spark, gate.replace("n: 60", "n: 61"), s)["verdict"] == "fail"
    twice = {"stats": [s["stats"][0], s["stats"][1] | {"name": "s1"}, s["stats"][1] | {"name": "s2"}]}
    assert {r.distance_in_spreads for r in reports.noise_floor(spark, twice, ["s1", "s2"]).collect()} == {None}
    with pytest.raises(gates.GateError):
        reports.noise_floor(spark, twice, ["s1"])


def test_specs():
    assert [reports.parse_spec(s) for s in ("a=b=c.npy", "x/y.npy", "=x/y.npy")] == [("a", "b=c.npy"), ("y", "x/y.npy"), ("y", "x/y.npy")]


def test_streamed_average(spark, tmp_path):
    """As the table's average, over nulls, triggers and a restart."""
    from corpuslens.operators import fidelity

    parts = [[("k", 1, 1.0), ("j", 2, 4.0), ("j", 1, None), ("n", 1, None)], [("k", 3, 5.0), ("k", 2, 3.0), ("n", 2, None)], [("j", 3, None), ("k", 4, 2.0), ("j", 4, 8.0), ("n", 3, 7.0)]]
    kind = "key string, step long, x double"

    def go():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = ema(stream, 0.5).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i != 1:  # the second and the third trigger run after a restart
            go()
    got = {(r.key, r.step): r.ema for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.key, r.step): r.ema for r in fidelity.ema(spark.createDataFrame([r for p in parts for r in p], kind), 0.5).collect()}
    assert got == want and want["n", 2] is None and want["n", 3] == 7


def test_report_has_every_series_and_whole_panels(spark, tmp_path, monkeypatch):
    from corpuslens.plans import reports

    rng = np.random.default_rng(5)
    for name in ("real", "a", "b"):
        np.save(tmp_path / f"{name}.npy", rng.standard_normal((30, 4)).astype(np.float32))
    monkeypatch.setattr(reports, "series_stats", lambda df, config: {})
    seen = []

    def panel(context):
        df = context.df
        seen.append(sorted(r.series for r in df.select("series").distinct().collect()))
        return {"long": spark.range(350).withColumnRenamed("id", "dim")}

    monkeypatch.setattr(reports.panels, "report", panel)
    out = reports.eda_report(spark, str(tmp_path / "real.npy"), str(tmp_path / "out"), [f"a={tmp_path}/a.npy", f"b={tmp_path}/b.npy"])
    assert seen == [["a", "b", "real"]] and list(out["panels"]) == ["long"]
    assert all(len(open(p).readlines()) == 350 for p in out["panels"].values())


def test_two_series_share_axes_and_one_order(spark, tmp_path):
    """Dimension 0 is worst in the first series and 2 in the second; both are shown for both, on edges over all three."""
    rng = np.random.default_rng(6)
    real = rng.standard_normal((80, 4)).astype(np.float32)
    a, b = real + np.float32([9, 0, 0, 0.1]), real + np.float32([0, 0, 5, 0.1])
    for name, x in (("real", real), ("a", a), ("b", b)):
        np.save(tmp_path / f"{name}.npy", x)
    config = panels.Config(k=10, k_hub=5, rows=60, knn_rows=30, nlist=8, pairs=200, bins=8, top=2, preprocess="none")
    out = reports.eda_report(spark, str(tmp_path / "real.npy"), str(tmp_path / "out"), [f"a={tmp_path}/a.npy", f"b={tmp_path}/b.npy"], config)
    assert {s: [w["dim"] for w in worst] for s, worst in out["worst_dimensions"].items()} == {"a": [0, 2], "b": [0, 2]}
    assert out["worst_dimensions"]["a"][0]["wasserstein1"] == pytest.approx(9, abs=1e-5) and out["worst_dimensions"]["b"][1]["wasserstein1"] == pytest.approx(5, abs=1e-5)
    for name in ("values", "norms", "pairwise", "knn", "lid"):
        rows = [json.loads(r) for r in open(out["panels"][name])]
        assert {r["series"] for r in rows} == {"real", "a", "b"}
        edges = {}
        for r in rows:
            assert edges.setdefault(r["bin"], (r["lo"], r["hi"])) == (r["lo"], r["hi"])
    page = (tmp_path / "out" / "report.html").read_text()
    assert "All series: n=60, k=10, nlist=8" in page and "No queries" not in page and out["knn_settings"]["max_rows"] == 30


def test_notes_on_what_differs():
    base = {"ann_k": 5, "ann_measured_rows": 10, "lid_discarded_queries": 10}
    text = panels.discarded_note([base | {"name": "copies"}, base | {"name": "pair", "ann_k": 1}, base | {"name": "fine", "lid_discarded_queries": 9}, base | {"name": "none", "ann_measured_rows": 0, "lid_discarded_queries": 0}])
    assert "copies (every query has an exact copy" in text and "pair (with k=1" in text and "fine" not in text and "none" not in text
    assert panels.discarded_note([base | {"name": "fine", "lid_discarded_queries": 0}]) == ""


SMALL = panels.Config(k=10, k_hub=5, rows=50, nlist=8, pairs=200, bins=8, top=4, glyphs=3)


def test_structure_of_a_corpus(spark, files, tmp_path):
    got = reports.structure_report(spark, f"{files}/real.npy", str(tmp_path), draws=2, config=SMALL)
    x = np.load(files / "real.npy").astype(float)
    n = np.linalg.norm(x, axis=1)
    assert got["facts"]["rows"] == 200 and got["facts"]["norm_mean"] == pytest.approx(n.mean())
    assert got["facts"]["mean_norm"] == pytest.approx(np.linalg.norm(x.mean(0)))
    assert set(got["noise_floor"]) == set(gates.STATISTICS) and json.load(open(tmp_path / "summary.json")) == got
    assert all((tmp_path / f"{p}.jsonl").stat().st_size for p in ("norms", "cosines", "spectrum"))


def test_variants_are_compared(spark, files, tmp_path):
    from corpuslens.operators import generator as G

    runs = {"whole": "data: {}", "moved": "data: {preprocess: {center: true}}", "bare": None}
    for name, config in runs.items():
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "best_generator.pt").touch()
        if config:
            (tmp_path / "r" / name / "run_config.yaml").write_text(config)
    manifest = "variants: [" + ", ".join(f"{{name: {n}, config: c, run_dir: r/{n}}}" for n in (*runs, "gone")) + "]"
    networks = {"whole": (G.Mlp(G.random_layers([4, 8], 1)), 4, 8)}
    out = reports.compare_variants(spark, manifest, str(tmp_path), f"{files}/real.npy", str(tmp_path / "out"), networks, 60, SMALL)
    assert [s["name"] for s in out["stats"]] == ["real", "whole"] and set(out["skipped"]) == {"moved", "bare", "gone"}
    assert np.load(tmp_path / "out" / "whole.npy").shape == (60, 8)
    assert {"scatter", "ivf"} <= set(out["panels"]) and "glyphs" not in out["panels"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "deep.yaml").write_text(manifest)
    assert gates.known_datasets(str(tmp_path / "m")) == ["deep"] and gates.manifest_of("m", "deep") == "m/deep.yaml"
    with pytest.raises(gates.GateError):
        reports.compare_variants(spark, "variants: [{name: gone, config: c, run_dir: r/gone}]", str(tmp_path), "x", "y", {})


def test_samples_of_a_whitened_run_are_compared(spark, tmp_path):
    """Whitened without centring, as such runs are: what the network draws is brought back to the corpus's coordinates, direction by direction."""
    from corpuslens.operators import generator as G
    from corpuslens.operators import preprocess

    rng = np.random.default_rng(8)
    scale = np.array([1.0, 2, 4, 8, 16, 32, 3, 6])
    x = rng.standard_normal((300, 8)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    np.save(tmp_path / "real.npy", x.astype(np.float32))
    state = preprocess.fit(df, preprocess.Settings(whiten=True))
    recorded = {"descriptor_dim": 8, "mean": None, "whitening_matrix": state.matrix, "config": {"center": False, "whiten": True, "l2_normalize": True}}
    network = G.Mlp(G.random_layers([6, 8], 3))
    for name, config in (("w", "data: {preprocess: {whiten: true, center: false, l2_normalize: true}}"), ("u", "data: {}")):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "best_generator.pt").touch()
        (tmp_path / "r" / name / "run_config.yaml").write_text(config)
        (tmp_path / "r" / name / "run_metadata.json").write_text(json.dumps({"preprocess_state": recorded}))
    manifest = "variants: [{name: w, config: c, run_dir: r/w}, {name: u, config: c, run_dir: r/u}]"
    out = reports.compare_variants(spark, manifest, str(tmp_path), str(tmp_path / "real.npy"), str(tmp_path / "out"), {n: (network, 6, 8) for n in "wu"}, 200, SMALL)
    assert [s["name"] for s in out["stats"]] == ["real", "w", "u"] and not out["skipped"]
    drawn = G.generate(spark, network, 200, 6, 8, reports.sampling.variant_seed(42, "w")).orderBy("vec_id").collect()
    want = np.array([r.v for r in drawn], float) @ np.linalg.inv(np.array(state.matrix))
    got = np.load(tmp_path / "out" / "w.npy")
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert np.corrcoef(np.log(got.std(0)), np.log(scale))[0, 1] > 0.7 > abs(np.corrcoef(np.log(np.load(tmp_path / "out" / "u.npy").std(0)), np.log(scale))[0, 1]) - 0.3


def test_panels_of_wide_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.maximum(rng.standard_normal(128), 0).tolist(), "real" if i < 20 else "synth") for i in range(40)]
    built = panels.report(panels.Context(spark.createDataFrame(rows, "vec_id long, v array<double>, series string"), SMALL))
    rays = built["glyphs"].select("vec_id").distinct().collect()
    assert len(rays) == 9 and len({r.vec_id.split(":")[0] for r in rays}) == 3
    curve = {s: [r.share_points for r in built["ivf"].where(f"series = '{s}'").orderBy("i").collect()] for s in ("real", "synth")}
    assert all(len(c) == 8 and c == sorted(c) and c[-1] == 1 for c in curve.values())


def test_commands(spark, files, tmp_path, capsys):
    from corpuslens.__main__ import main

    stats = {"lid_median": 12.0, "relative_contrast_median": 2.0, "hubness_skew": 2.0, "ivf_gini": 0.3, "ann_measured_rows": 5, "ann_k": 2, "ann_nlist": 2}
    (tmp_path / "s.json").write_text(json.dumps({"stats": [stats | {"name": "real"}, stats | {"name": "a", "lid_median": 13.0}, stats | {"name": "b", "lid_median": 14.0}]}))
    gate = "canonical: {n: 5, k: 2, k_hub: 1, nlist: 2}\nstatistics: {lid_median: {min: %d}, relative_contrast_median: {min: 1}, hubness_skew: {min: 1}, ivf_gini: %s}"
    for low, gini, code in ((8, "{min: 0}", 0), (13, "{min: 0}", 1), (8, "null", 2)):
        (tmp_path / "g.yaml").write_text(gate % (low, gini))
        assert main(["gate", str(tmp_path / "g.yaml"), str(tmp_path / "s.json")], spark) == code
    assert main(["gate", str(tmp_path / "g.yaml"), str(tmp_path / "s.json"), "--allow-unset"], spark) == 0
    capsys.readouterr()
    # A gate that can't be checked fails, and says so elsewhere than a verdict.
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "summary.json").write_text((tmp_path / "s.json").read_text())
    (tmp_path / "bad.yaml").write_text("[")
    for args in (["g.yaml", "s.json", "--series", "none"], ["bad.yaml", "s.json"], ["absent.yaml", "s.json"], ["g.yaml", "absent.json"], ["g.yaml"], ["g.yaml", "s.json", "--dataset", "g"]):
        assert main(["gate", *(str(tmp_path / x) if "." in x else x for x in args), "--output", str(tmp_path / "none.json")], spark) == 1
        assert not capsys.readouterr().out and not (tmp_path / "none.json").exists()
    by_name = ["gate", "--dataset", "g", "--gates-dir", str(tmp_path), "--run-dir", str(tmp_path / "run"), "--stats-name", "a", "--allow-unset", "--output", str(tmp_path / "o" / "out.json")]
    assert main(by_name, spark) == 0
    assert json.loads(capsys.readouterr().out) == json.load(open(tmp_path / "o" / "out.json"))
    assert main(["floor", str(tmp_path / "s.json"), "a", "b"], spark) == 0
    assert {r["statistic"]: r["gap"] for r in json.loads(capsys.readouterr().out)}["lid_median"] == 1.5
