"""Whole runs: comparing files, the report of a corpus and its stand-ins, the gate and the noise floor. Each is a function with the defaults of its command."""

from __future__ import annotations

import html
import json
import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.vectors import as_double, l2_normalize, norm
from corpuslens.operators import difficulty, fidelity, gates, generator, panels, preprocess, sampling, structure
from corpuslens.sources import matrices


def put(path: str, text: str) -> None:
    """Writes a small driver-side file whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def put_rows(path: str, rows: DataFrame, shown: int) -> list[list]:
    """Writes all rows as JSON lines, a partition at a time; returns the first `shown`."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    head = []
    with open(f"{path}.part", "w") as f:
        for r in rows.toLocalIterator():
            f.write(json.dumps(r.asDict(True), default=str) + "\n")
            if len(head) < shown:
                head.append(list(r))
    os.replace(f"{path}.part", path)
    return head


def parse_spec(spec: str) -> tuple[str, str]:
    """[LABEL=]PATH."""
    label, sep, path = spec.partition("=")
    label, path = (label, path) if sep else ("", spec)
    return label or os.path.splitext(os.path.basename(path))[0], path


def load_series(spark: SparkSession, real_path: str, synthetic: list[str] = (), rows: int = 50_000, preprocess: str = "l2", seed: int = 42) -> DataFrame:
    """vec_id, v, series: each file sampled, then normalised. Labels that repeat and differing dimensions are errors."""
    if preprocess not in ("l2", "none"):
        raise ValueError("series are preprocessed by l2 or none")
    specs = [("real", real_path), *map(parse_spec, synthetic)]
    if len({name for name, _ in specs}) < len(specs):
        raise ValueError("two series have the same label")
    out, dims = None, set()
    for name, path in specs:
        df = matrices.load(spark, path).select("vec_id", as_double(F.col("v")).alias("v"))
        dims |= {r.d for r in df.select(F.size("v").alias("d")).distinct().collect()}
        df = sampling.sample(df, rows, seed)
        df = (l2_normalize(df) if preprocess == "l2" else df).withColumn("series", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if len(dims) != 1:
        raise ValueError(f"the series have {', '.join(map(str, sorted(dims)))} dimensions")
    return out


def evaluate_files(spark: SparkSession, real_path: str, synthetic_path: str, output_dir: str | None = None, num_samples: int = 5000, holdout_fraction: float = 0.05, gamma: float = 1.0, seed: int = 42, normalize: bool = True) -> dict:
    """Seven measures of a synthetic file against a real one's held-out part, of equal numbers of rows; metrics.json if there is a folder for it."""
    both = load_series(spark, real_path, [f"synth={synthetic_path}"], 0, "l2" if normalize else "none", seed)
    split = sampling.holdout_split(both.where("series = 'real'"), holdout_fraction, seed)
    held, train, synth = split.where("is_holdout").drop("is_holdout"), split.where("not is_holdout").drop("is_holdout"), both.where("series = 'synth'")
    n = min(num_samples, held.count(), synth.count())
    real, fake = sampling.sample(held, n, seed).persist(), sampling.sample(synth, n, seed).persist()  # released below
    moments = fidelity.mean_var_l2(real.unionByName(fake)).first()
    hist = fidelity.pairwise_hist_l1(sampling.sample(real, 5000, seed), sampling.sample(fake, 5000, seed))
    out = {
        "mean_l2": moments.mean_l2,
        "var_l2": moments.var_l2,
        "cov_fro": fidelity.covariance_fro(real.unionByName(fake)),
        "mmd_rbf": fidelity.mmd_rbf(sampling.sample(real, 5000, seed), sampling.sample(fake, 5000, seed), gamma),
        "pairwise_hist_l1": hist.agg(F.sum(F.abs(F.col("real") - F.col("synth")))).first()[0],
        "knn_recall": fidelity.knn_recall(real, train, fake).first().knn_recall,
        "ann_proxy_recall": fidelity.ann_proxy_recall(real, train, fake).first().ann_proxy_recall,
        "num_samples_used": n,
    }
    real.unpersist()
    fake.unpersist()
    if output_dir:
        put(f"{output_dir}/metrics.json", json.dumps(out, indent=2))
    return out


def series_stats(df: DataFrame, config: panels.Config) -> dict:
    """The statistics of one series, as the summary holds them."""
    v = F.col("v")
    whole = F.sha2(F.to_csv(F.struct(F.transform(v, lambda x: x + F.lit(0.0)).cast("string").alias("v"))).cast("binary"), 256)  # equal rows have equal digests
    own = df.select(whole.alias("whole"), norm(v).alias("n"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("m"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v)).alias("m2"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), (F.size(F.filter(v, lambda x: x == 0)) / F.size(v)).alias("z"), (F.size(F.filter(v, lambda x: x < 0)) / F.size(v)).alias("neg"))
    a = own.agg(F.count(F.lit(1)).alias("rows"), F.avg("m").alias("mean"), F.sqrt(F.avg("m2") - F.pow(F.avg("m"), 2)).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.avg("z").alias("zero_fraction"), F.avg("neg").alias("negative_fraction"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), (1 - F.count_distinct("whole") / F.count(F.lit(1))).alias("duplicate_fraction")).first().asDict()
    pairs = structure.pair_values(df, config.pairs, config.seed, structure.distance).agg(F.percentile("x", F.lit(0.5))).first()[0]
    kth = panels.kth_distance(sampling.sample(df, config.knn_rows, config.seed), config.knn).agg(F.percentile("x", F.lit(0.5))).first()[0]
    rank = structure.effective_rank(next(iter(structure.eigenvalues(df, True, 1).values())), a["rows"])
    ann = difficulty.summary(df, config.k, config.k_hub, config.nlist, config.rows, config.seed, difficulty.CONTRAST_TARGETS).first().asDict()
    return a | {"median_pairwise_distance": pairs, f"median_{config.knn}nn_distance": kth, "effective_rank": rank} | ann


def eda_report(spark: SparkSession, real_path: str, output_dir: str, synthetic: list[str] = (), config: panels.Config | None = None, max_vectors: int = 50_000, metric: str = "l2") -> dict:
    """summary.json and report.html of a corpus and any number of stand-ins, and every panel whole in a file of JSON lines; returns the summary."""
    config = config or panels.Config()
    df = load_series(spark, real_path, synthetic, max_vectors, config.preprocess, config.seed).persist()
    if metric == "angular":
        structure.require_unit_norm(df)
    names = ["real", *(parse_spec(s)[0] for s in synthetic)]
    stats = [{"name": s, **series_stats(df.where(F.col("series") == s), config)} for s in names]
    worst: dict[str, list[dict]] = {s: [] for s in names[1:]}
    for r in fidelity.divergences(df, config.top).orderBy("ord").collect() if names[1:] else ():  # config.top rows for each series
        worst[r.series].append({"dim": r.dim, "wasserstein1": r.w1})
    built = panels.report(panels.Context(df, config))  # all series on the same axes
    body, files = [stats_table(stats), *(f"<p>{html.escape(n)}</p>" for n in notes(spark, stats) if n)], {}
    for i, (name, rows) in enumerate(built.items()):
        files[name] = f"{output_dir}/panel_{i}.jsonl"
        head = put_rows(files[name], rows.orderBy(*rows.columns[:3]), 200)
        body.append(f"<h2>{html.escape(name)}</h2><p><a href='panel_{i}.jsonl'>all rows</a></p>" + table_html(rows.columns, head))
    put(f"{output_dir}/report.html", "<!doctype html><meta charset=utf-8><title>Report</title>" + "".join(body))
    summary = {
        "real_path": real_path, "synthetic_paths": list(synthetic), "preprocess": config.preprocess, "seed": config.seed,
        "ann_settings": {"k": config.k, "k_hub": config.k_hub, "max_rows": config.rows, "nlist": config.nlist, "metric": metric},
        "knn_settings": {"k": config.knn, "max_rows": config.knn_rows}, "stats": stats, "worst_dimensions": worst, "panels": files, "report_html": f"{output_dir}/report.html",
    }
    put(f"{output_dir}/summary.json", json.dumps(summary, indent=2))
    df.unpersist()
    return summary


def notes(spark: SparkSession, stats: list[dict]) -> list[str]:
    """How the series were measured, and which have no queries left."""
    if not all("ann_k" in s for s in stats):
        return []
    rows = [(s["name"], s["ann_measured_rows"], s["ann_k"], s["ann_nlist"]) for s in stats]
    return [panels.condition_note(spark.createDataFrame(rows, "series string, n long, k long, nlist long")).first().note, panels.discarded_note(stats)]


def structure_report(spark: SparkSession, path: str, output_dir: str | None = None, rows: int = 50_000, draws: int = 10, config: panels.Config | None = None) -> dict:
    """Facts about one corpus as it is stored: norms, cosines, anisotropy, spectrum, and how far its statistics move between disjoint draws;
    with a folder, summary.json and report.html with the panels of all these."""
    config = config or panels.Config()
    df = load_series(spark, path, (), rows, "none", config.seed).persist()
    n = df.count()
    cosines = structure.pair_values(df, config.pairs, config.seed, structure.cosine).select(F.lit("real").alias("series"), "x")
    draw = structure.draw_statistics(df, draws, min(config.rows, n // draws), config.k, config.k_hub, config.nlist, config.seed)
    floor = structure.draw_floor(structure.long_statistics(draw, "draw")).orderBy("statistic")
    spectrum = structure.spectrum_facts(structure.eigenvalues(df)["real"])
    quantiles = cosines.agg(F.percentile("x", F.lit(0.5)).alias("pair_cosine_median"), F.percentile("x", F.lit(0.99)).alias("pair_cosine_p99"))
    facts = {"rows": n} | structure.norm_facts(df).first().asDict() | structure.anisotropy(df).first().asDict() | quantiles.first().asDict() | spectrum
    out = {"path": path, "facts": facts, "noise_floor": {r.statistic: r.asDict() for r in floor.collect()}}
    if output_dir:
        shown = {"norms": panels.steady_histogram(panels.norms(df), config.bins), "cosines": panels.steady_histogram(cosines, config.bins), "spectrum": panels.pca_spectrum(df)}
        body = [table_html(["fact", "value"], list(facts.items())), table_html(floor.columns, [list(r) for r in floor.collect()])]
        for name, panel in shown.items():
            head = put_rows(f"{output_dir}/{name}.jsonl", panel.orderBy(*panel.columns[:2]), 200)
            body.append(f"<h2>{name}</h2><p><a href='{name}.jsonl'>all rows</a></p>" + table_html(panel.columns, head))
        put(f"{output_dir}/report.html", "<!doctype html><meta charset=utf-8><title>Structure</title>" + "".join(body))
        put(f"{output_dir}/summary.json", json.dumps(out, indent=2))
    df.unpersist()
    return out


def generate_samples(spark: SparkSession, name: str, network, latent: int, width: int, rows: int, path: str, seed: int = 42, state: preprocess.State | None = None) -> int:
    """A variant's samples as a .npy file, by a seed of its own name, in the corpus's coordinates."""
    made = generator.generate(spark, network, rows, latent, width, sampling.variant_seed(seed, name))
    return matrices.write_npy(preprocess.invert(made.select("vec_id", as_double(F.col("v")).alias("v")), state), path)


def compare_variants(spark: SparkSession, manifest: str, root: str, real_path: str, output_dir: str, networks: dict, rows: int = 50_000, config: panels.Config | None = None) -> dict:
    """The report of a corpus beside the samples of each variant of a manifest (its text) whose run is whole; the summary, with what was left out
    and why. networks: name -> (network, latent, width), as checkpoints of other libraries aren't read. All variants must be of one metric."""
    variants = gates.load_variants(manifest)
    files = gates.run_files(spark, root, variants)
    checked = gates.resolve_variants(spark.createDataFrame([(v["name"], v["run_dir"]) for v in variants], "name string, run_dir string"), files).collect()  # a row for each variant
    reasons = {r.name: r.reason for r in checked}
    found = [v for v in variants if reasons[v["name"]] is None]
    if not found:
        raise gates.GateError(f"no variant is whole: {'; '.join(f'{n}: {r}' for n, r in reasons.items())}")
    texts = {r.path: r.text for r in files.collect()}
    configs = {v["name"]: yaml.safe_load(texts[f"{v['run_dir']}/{gates.RUN_CONFIG}"]) or {} for v in found}
    metrics = {((c.get("data") or {}).get("preprocess") or {}).get("metric", "l2") for c in configs.values()}
    if len(metrics) > 1:
        raise gates.GateError(f"the variants are of several metrics: {', '.join(sorted(metrics))}")
    os.makedirs(output_dir, exist_ok=True)
    specs = []
    for v in found:
        metadata = texts.get(f"{v['run_dir']}/{gates.RUN_METADATA}")
        state = preprocess.State.from_run(metadata) if metadata and preprocess.needs_inversion(texts[f"{v['run_dir']}/{gates.RUN_CONFIG}"]) else None
        path = f"{output_dir}/{v['name']}.npy"
        generate_samples(spark, v["name"], *networks[v["name"]], rows, path, state=state)
        specs.append(f"{v['name']}={path}")
    return eda_report(spark, real_path, output_dir, specs, config, metric=metrics.pop()) | {"skipped": {n: r for n, r in reasons.items() if r is not None}}


def table_html(columns: list[str], rows: list[list]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return f"<table>{line('th', columns)}{''.join(line('td', [panels.format_stat(x) if isinstance(x, (int, float)) or x is None else x for x in r]) for r in rows)}</table>"


def stats_table(stats: list[dict]) -> str:
    keys = list(dict.fromkeys(k for s in stats for k in s))
    return table_html(keys, [[s.get(k) for k in keys] for s in stats])


def check_gate(spark: SparkSession, gate_text: str, summary: dict, name: str = "real", allow_unset: bool = False, allow_mismatch: bool = False) -> dict:
    """verdict, exit_code (0 pass, 1 fail, 2 unset), and the outcome of each statistic and condition. No vectors are read."""
    gate, stats = gates.load_gate(gate_text), gates.entry(summary, name)
    values = [(s, None if stats.get(s) is None else float(stats[s])) for s in structure.STATISTICS if s in stats and (stats[s] is None or isinstance(stats[s], (int, float)) and not isinstance(stats[s], bool))]
    checked = gates.check_statistics(spark.createDataFrame(values, "statistic string, value double"), gates.bands(spark, gate))
    actual = [(c, stats.get(k)) for c, k in (("n", "ann_measured_rows"), ("k", "ann_k"), ("nlist", "ann_nlist"))]
    conditions = gates.check_conditions(spark.createDataFrame(actual, "condition string, actual long"), spark.createDataFrame(list(gate["canonical"].items()), "condition string, expected long"))
    return gates.verdict(checked, conditions, allow_unset, allow_mismatch).first().asDict() | {"statistics": {r.statistic: r.outcome for r in checked.collect()}, "conditions": {r.condition: r.ok for r in conditions.collect()}}


def noise_floor(spark: SparkSession, summary: dict, series: list[str], real_name: str = "real") -> DataFrame:
    """The floor of two series or more that differ by seed only. All must have been measured alike."""
    if len(series) < 2:
        raise gates.GateError("a spread needs two series at least")
    stats = [gates.entry(summary, s) for s in (*series, real_name)]
    if len({tuple(s.get(k) for k in ("ann_measured_rows", "ann_k", "ann_nlist")) for s in stats}) > 1:
        raise gates.GateError("the series were measured under different conditions")
    rows = [(k, gates.strict_value(s, k)) for s in stats[:-1] for k in structure.STATISTICS]
    real = [(k, gates.strict_value(stats[-1], k)) for k in structure.STATISTICS]
    return structure.floor(spark.createDataFrame(rows, "statistic string, value double"), spark.createDataFrame(real, "statistic string, real double"))
