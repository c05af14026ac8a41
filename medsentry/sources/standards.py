"""Curated inputs: drug-string overrides and reference standards of drug-event pairs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NormalizationError, ReferenceSetError
from ..functions.text import fold

DISPOSITIONS = ("ingredient", "not_a_drug")
#: Positive and negative pairs each standard was published with.
PUBLISHED = {"harpaz": (62, 75), "omop": (165, 234), "euadr": (43, 50)}


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(folded, disposition, ingredient_rxcui, ingredient_name, note); of rows for one string the last wins."""
    raw = spark.read.csv(path, header=True, inferSchema=False, schema=None, multiLine=True)
    need = {"raw", "disposition", "ingredient_rxcui", "ingredient_name", "note"}
    if need - set(raw.columns):
        raise NormalizationError(f"{path}: missing columns {sorted(need - set(raw.columns))}")
    rows = raw.withColumn("line", F.monotonically_increasing_id()).withColumn("folded", fold(F.col("raw")))
    rxcui = F.coalesce(F.trim("ingredient_rxcui"), F.lit(""))
    drug = F.col("disposition") == "ingredient"
    bad = ~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)) | (F.coalesce(F.trim("note"), F.lit("")) == "") | (drug & ~rxcui.rlike(r"^\d+$")) | (~drug & (rxcui != ""))
    if wrong := rows.filter(bad).select("raw").limit(5).collect():
        raise NormalizationError(f"{path}: malformed overrides for {[r.raw for r in wrong]}")
    order = Window.partitionBy("folded").orderBy(F.desc("line"))
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("folded", "disposition", F.when(rxcui != "", rxcui).alias("ingredient_rxcui"), "ingredient_name", "note")


def outcome_map(spark: SparkSession, path: str | Path) -> DataFrame:
    """(outcome_id, pt) of a YAML map ``outcome: [terms]``, in block or flow form."""
    out, key = [], None
    for number, line in enumerate(Path(path).read_text().splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body or body.lstrip().startswith("#"):
            continue
        if body.lstrip().startswith("- ") and key:
            out.append((key, body.lstrip()[2:].strip().strip("'\"")))
        elif ":" in body and not body.startswith(" "):
            key, _, rest = body.partition(":")
            key = key.strip().strip("'\"")
            out += [(key, v.strip().strip("'\"")) for v in rest.strip().strip("[]").split(",") if v.strip()]
        else:
            raise ReferenceSetError(f"{path}:{number}: neither a key nor a term")
    return spark.createDataFrame(out, "outcome_id string, pt string").select("outcome_id", fold(F.col("pt")).alias("pt"))


def reference_set(spark: SparkSession, name: str, path: str, outcomes: DataFrame, published: dict | None = None) -> DataFrame:
    """The pairs of a standard, checked: labels 0 or 1, names given, outcomes known, the published numbers of each kind.

    A blank rxcui is kept as null: the pair can't be mapped and is counted as such.
    """
    want = (published or PUBLISHED).get(name)
    if want is None:
        raise ReferenceSetError(f"no published counts for {name}")
    raw = spark.read.csv(path, header=True, inferSchema=False)
    need = {"drug_name", "ingredient_rxcui", "outcome_id", "label", "source_note"}
    if need - set(raw.columns):
        raise ReferenceSetError(f"{path}: missing columns {sorted(need - set(raw.columns))}")
    rxcui = F.trim("ingredient_rxcui")
    rows = raw.select(F.lit(name).alias("reference_set"), F.trim("drug_name").alias("drug_name"), F.when(rxcui != "", rxcui).alias("ingredient_rxcui"), F.trim("outcome_id").alias("outcome_id"), F.trim("label").alias("label"), F.col("source_note"))
    bad = (F.coalesce("drug_name", F.lit("")) == "") | ~F.coalesce(F.col("label").isin("0", "1"), F.lit(False)) | F.coalesce(~F.col("ingredient_rxcui").rlike(r"^\d+$"), F.lit(False))
    if wrong := rows.filter(bad).limit(5).collect():
        raise ReferenceSetError(f"{path}: malformed rows {[r.drug_name for r in wrong]}")
    if lost := rows.join(outcomes, "outcome_id", "left_anti").select("outcome_id").distinct().limit(5).collect():
        raise ReferenceSetError(f"{path}: outcomes without terms {[r.outcome_id for r in lost]}")
    found = rows.agg(F.count_if(F.col("label") == "1").alias("p"), F.count_if(F.col("label") == "0").alias("n")).first()
    if (found.p, found.n) != want:
        raise ReferenceSetError(f"{path}: {found.p} positive and {found.n} negative pairs, published are {want}")
    return rows.withColumn("label", F.col("label").cast("int"))


def reference_sets(spark: SparkSession, folder: str | Path, names: tuple[str, ...] = tuple(PUBLISHED), published: dict | None = None) -> DataFrame:
    """All standards of a folder (``name.csv`` and ``outcomes.yaml``); every missing file is named at once."""
    files = [Path(folder) / f"{n}.csv" for n in names] + [Path(folder) / "outcomes.yaml"]
    if absent := [str(f) for f in files if not f.exists()]:
        raise ReferenceSetError(f"missing: {', '.join(absent)}")
    outcomes, out = outcome_map(spark, files[-1]), None
    for n, f in zip(names, files, strict=False):
        part = reference_set(spark, n, str(f), outcomes, published)
        out = part if out is None else out.unionByName(part)
    return out
