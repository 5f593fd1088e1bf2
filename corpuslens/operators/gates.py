"""Bands for statistics, verdicts on them, and variant manifests."""

from __future__ import annotations

import copy
import math
import os

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.structure import STATISTICS

CONDITIONS = ("n", "k", "k_hub", "nlist")


class GateError(Exception):
    """A gate, manifest or summary that can't be used."""


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def load_gate(text: str) -> dict:
    """A gate from YAML: dataset, canonical {n, k, k_hub, nlist} and statistics {name: null or {min, max}}; refused unless whole and well formed."""
    try:
        gate = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise GateError(f"not YAML: {e}") from e
    if not isinstance(gate, dict):
        raise GateError("a gate is a mapping")
    for part in ("canonical", "statistics"):
        if not isinstance(gate.get(part), dict):
            raise GateError(f"{part} is missing or no mapping")
    for part, names in (("canonical", CONDITIONS), ("statistics", STATISTICS)):
        if lacking := sorted(set(names) - set(gate[part])):
            raise GateError(f"{part} lacks {', '.join(lacking)}")
        if unknown := sorted(set(gate[part]) - set(names)):
            raise GateError(f"{part} has unknown {', '.join(map(str, unknown))}")
    for name, x in gate["canonical"].items():
        if not isinstance(x, int) or isinstance(x, bool) or x < 1:
            raise GateError(f"canonical {name} must be a whole number above 0")
    for name, band in gate["statistics"].items():
        if band is None:
            continue
        if not isinstance(band, dict) or set(band) - {"min", "max"}:
            raise GateError(f"the band of {name} has min and max only")
        low, high = band.get("min"), band.get("max")
        if any(x is not None and not _number(x) for x in (low, high)):
            raise GateError(f"the band of {name} isn't of finite numbers")
        if low is not None and high is not None and low > high:
            raise GateError(f"the band of {name} is empty")
    return gate


def bands(spark, gate: dict) -> DataFrame:
    rows = [(n, *((float(x) if x is not None else None) for x in ((b or {}).get("min"), (b or {}).get("max")))) for n, b in gate["statistics"].items()]
    return spark.createDataFrame(rows, "statistic string, min double, max double")


def outcome(value: Column, present: Column, low: Column, high: Column) -> Column:
    """fail where the statistic is absent, null or not a number, even without a band; unset without bounds; else whether the value lies within (bounds belong to it)."""
    bad = ~present | value.isNull() | F.isnan(value)
    out = (low.isNotNull() & (value < low)) | (high.isNotNull() & (value > high))
    return F.when(bad, "fail").when(low.isNull() & high.isNull(), "unset").when(out, "fail").otherwise("pass")


def check_statistics(values: DataFrame, bands: DataFrame) -> DataFrame:
    """values(statistic, value) and bands(statistic, min, max) -> statistic, value, min, max, outcome: a row for each band."""
    own = bands.join(values.withColumn("present", F.lit(True)), "statistic", "left")
    present = F.coalesce("present", F.lit(False))
    return own.select("statistic", "value", "min", "max", outcome(F.col("value"), present, F.col("min"), F.col("max")).alias("outcome"))


def check_conditions(actual: DataFrame, canonical: DataFrame) -> DataFrame:
    """condition, expected, actual, ok: rows measured, k and nlist after clamping; k_hub isn't recorded and so not checked."""
    return canonical.where("condition <> 'k_hub'").join(actual, "condition", "left").select("condition", "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))


def verdict(checked: DataFrame, conditions: DataFrame, allow_unset: bool = False, allow_mismatch: bool = False) -> DataFrame:
    """verdict and exit_code: fail (1) before unset (2) before pass (0)."""
    c = conditions.agg(F.count_if(~F.col("ok")).alias("off"))
    s = checked.agg(F.count_if(F.col("outcome") == "fail").alias("failed"), F.count_if(F.col("outcome") == "unset").alias("unset"))
    failed = (F.col("failed") > 0) | ((F.col("off") > 0) & F.lit(not allow_mismatch))
    v = F.when(failed, "fail").when(F.col("unset") > 0, "unset").otherwise("pass")
    return s.join(c).select(v.alias("verdict"), F.when(v == "fail", 1).when((v == "unset") & F.lit(not allow_unset), 2).otherwise(0).alias("exit_code"))  # single rows


def entry(summary: dict, name: str) -> dict:
    """The statistics of one series in a summary."""
    found = {s.get("name"): s for s in summary.get("stats", [])}
    if name not in found:
        raise GateError(f"no series {name!r}; there are {', '.join(sorted(map(str, found)))}")
    return found[name]


def strict_value(stats: dict, name: str) -> float:
    if not _number(stats.get(name)):
        raise GateError(f"{name} is {stats.get(name)!r}, not a number")
    return float(stats[name])


def load_variants(text: str) -> list[dict]:
    """A manifest's variants, in order: name, config, run_dir of each; names must differ."""
    body = yaml.safe_load(text)
    if not isinstance(body, dict) or not isinstance(body.get("variants"), list) or not body["variants"]:
        raise GateError("a manifest has a list of variants")
    seen: set = set()
    for v in body["variants"]:
        if not isinstance(v, dict) or (lacking := sorted({"name", "config", "run_dir"} - set(v))):
            raise GateError(f"a variant lacks {', '.join(lacking) if isinstance(v, dict) else 'everything'}")
        if v["name"] in seen:
            raise GateError(f"the name {v['name']!r} comes twice")
        seen.add(v["name"])
    return body["variants"]


def family_metric(variants: DataFrame) -> DataFrame:
    """family, metric, agreed: the one metric of a family's variants, null if they differ."""
    g = variants.groupBy("family").agg(F.count_distinct("metric").alias("n"), F.min("metric").alias("m"))
    return g.select("family", F.when(F.col("n") == 1, F.col("m")).alias("metric"), (F.col("n") == 1).alias("agreed"))


def sweep_cells(rungs: DataFrame, seeds: DataFrame) -> DataFrame:
    """rung, seed, name: a configuration for each rung and seed (both lists of a manifest's size)."""
    return rungs.crossJoin(F.broadcast(seeds)).select("rung", "seed", F.concat_ws("_", "rung", F.concat(F.lit("s"), "seed")).alias("name"))


def subset_name(dataset: Column, rows: Column) -> Column:
    """deep_1m from a million rows on, else in thousands: sift_250k."""
    unit = F.when(rows >= 1_000_000, F.lit(1_000_000)).otherwise(F.lit(1000))
    size = F.concat(F.floor(rows / unit).cast("string"), F.when(rows >= 1_000_000, "m").otherwise("k"))
    return F.concat_ws("_", dataset, size)


def parse_spec(spec: Column) -> tuple[Column, Column]:
    """[LABEL=]PATH: only the first equals sign splits; an empty or missing label is the file's stem."""
    cut = F.instr(spec, "=")
    path = F.when(cut > 0, F.expr("substring(spec, instr(spec, '=') + 1)")).otherwise(spec)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    label = F.when(cut > 1, F.expr("substring(spec, 1, instr(spec, '=') - 1)")).otherwise(stem)
    return label, path


#: The files of a training run.
CHECKPOINT, RUN_CONFIG, RUN_METADATA = "best_generator.pt", "run_config.yaml", "run_metadata.json"


def resolve_variants(variants: DataFrame, files: DataFrame) -> DataFrame:
    """variants(name, run_dir) and files(path, text; null for what isn't text) -> name, found, reason: the first that a run lacks of its
    directory, checkpoint and configuration, or why its samples couldn't be brought back to the corpus's coordinates."""
    from corpuslens.operators import preprocess

    blocker = F.udf(lambda config, metadata: None if config is None else preprocess.run_blocker(config, metadata), "string")  # a row for each run
    parts = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("run_dir"), F.regexp_extract("path", "[^/]*$", 0).alias("file"), "text")
    text = lambda name: F.max(F.when(F.col("file") == name, F.col("text")))
    has = lambda name: F.bool_or(F.col("file") == name)
    runs = parts.groupBy("run_dir").agg(has(CHECKPOINT).alias("checkpoint"), has(RUN_CONFIG).alias("config"), text(RUN_CONFIG).alias("config_text"), text(RUN_METADATA).alias("metadata"))
    own = variants.select("name", "run_dir").join(runs, "run_dir", "left").withColumn("blocker", blocker("config_text", "metadata"))
    lacks = lambda what: F.concat(F.lit(f"no {what} in "), "run_dir")
    reason = F.when(F.col("checkpoint").isNull(), F.concat(F.lit("no run directory at "), "run_dir")).when(~F.col("checkpoint"), lacks(CHECKPOINT)).when(~F.col("config"), lacks(RUN_CONFIG)).otherwise(F.col("blocker"))
    return own.select("name", reason.isNull().alias("found"), reason.alias("reason"))


def run_files(spark, root: str, variants: list[dict]) -> DataFrame:
    """files(path, text) of the directories that a manifest names, by their paths in it."""
    rows = []
    for run in dict.fromkeys(v["run_dir"] for v in variants):
        at = os.path.join(root, run)
        for name in sorted(os.listdir(at)) if os.path.isdir(at) else ():
            text = None
            if name in (RUN_CONFIG, RUN_METADATA):
                with open(os.path.join(at, name)) as f:
                    text = f.read()
            rows.append((f"{run}/{name}", text))
        if os.path.isdir(at):
            rows.append((f"{run}/.", None))  # an empty directory is one too
    return spark.createDataFrame(rows, "path string, text string")


def manifest_of(folder: str, dataset: str) -> str:
    """Where a family's manifest lies."""
    return f"{folder}/{dataset}.yaml"


def known_datasets(folder: str) -> list[str]:
    """The families that have a manifest in the folder."""
    return sorted(f.removesuffix(".yaml") for f in os.listdir(folder) if f.endswith(".yaml")) if os.path.isdir(folder) else []


def with_changes(config: dict, changes: dict, output_dir: str) -> dict:
    """A copy of a configuration with other values at dotted keys, which must be there already, and its own output_dir."""
    out = copy.deepcopy(config)
    for key, value in changes.items():
        at, *parts = out, *key.split(".")
        for part in parts[:-1]:
            at = at[part]
        if parts[-1] not in at:
            raise GateError(f"{key} is no key of the configuration")
        at[parts[-1]] = value
    return out | {"output_dir": output_dir}
