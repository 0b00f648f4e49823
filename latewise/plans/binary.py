"""From raw order lines to scaled training tables for the two-class study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.operators.clean import drop_columns, fill_all
from latewise.operators.encode import LabelEncoder, OneHotEncoder
from latewise.operators.features import LABEL, add_order_features
from latewise.operators.profile import null_counts, profile
from latewise.operators.scale import Standardizer
from latewise.operators.select import BEST_K, VARIANCE_THRESHOLD, p_values, select_features, validity_counts
from latewise.operators.split import StratifiedSplit
from latewise.session import shuffles_freed, work_dir
from latewise.sources.tables import numeric_columns

ORDER = "order_id"
# Bytes of input files that are joined and shuffled in one pass, unless that makes more passes than the limit: each scans
# the lines again, so their number must not grow with the input for ever.
PASS_BYTES, MAX_PASSES = 32 << 20, 32


@dataclass(frozen=True)
class Prepared:
    """The scaled table (key, features, label, split) with what was fitted on the way.

    ``nulls`` (part, n_null) tells how many nulls were filled, where the study reports them.
    """

    table: DataFrame
    features: list[str]
    scaler: Standardizer
    split: StratifiedSplit
    nulls: DataFrame | None = None

    def part(self, name: str) -> DataFrame:
        return self.table.filter(F.col("split") == name).drop("split")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write once to the shared work folder and read back.

    The fitting passes that follow read single columns of the result instead of repeating the joins,
    and a lost executor costs no more than re-reading its files.
    """
    path = f"{work_dir(df.sparkSession)}/{name}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


def engineered(raw: DataFrame, as_published: bool = False) -> DataFrame:
    """Cleaned rows with all features, categories not yet encoded. One shuffle (distinct items per order)."""
    return add_order_features(fill_all(drop_columns(raw, as_published)))


def _source_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from; sources that do not tell their size count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def engineered_table(raw: DataFrame, name: str, as_published: bool = False, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``engineered``, written once to the shared work folder and read back.

    Joins and distinct items shuffle whole rows, several times their size in the files. So a large input is worked on in
    passes, each over the orders of one hash slice and about ``pass_bytes`` of the files, and the shuffle files are those
    of a pass. An order lies in one slice whole; orders without an id count as 0, as filled.
    """
    rows = fill_all(drop_columns(raw, as_published))
    passes = min(MAX_PASSES, max(1, -(-_source_bytes(raw) // pass_bytes))) if ORDER in rows.columns else 1
    path = f"{work_dir(raw.sparkSession)}/{name}"
    slices = [F.pmod(F.xxhash64(ORDER), F.lit(passes)) == i for i in range(passes)] if passes > 1 else [F.lit(True)]
    with shuffles_freed(raw.sparkSession):
        for mine in slices:
            add_order_features(rows.filter(mine)).write.mode("append").option("compression", "zstd").parquet(path)
    return raw.sparkSession.read.parquet(path)


def prepare_binary(
    raw: DataFrame, key: str = "row_key", threshold: float = VARIANCE_THRESHOLD, k: int = BEST_K,
    fit_on: str = "all", exclude: tuple[str, ...] = (), as_published: bool = False, seed: int = 42,
) -> Prepared:
    """Clean, build features, encode, select, split and scale.

    ``fit_on="all"`` fits encoders and selection on every row before the split, as the study does;
    ``"train"`` fits them on training rows only. The scaler always sees training rows only.
    ``on_time_delivery`` gives the label away by definition; name such columns in ``exclude`` to leave
    them out of the selection (after encoding they are prefixes, e.g. ``on_time_delivery_0``).
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    rows = engineered_table(raw, "features", as_published)
    split = StratifiedSplit.fit(rows, LABEL, key, seed=seed)
    rows = split.apply(rows)
    train = F.col("split") == "train"

    seen = rows.filter(train) if fit_on == "train" else rows
    labels = LabelEncoder.fit(seen, unseen="keep" if fit_on == "train" else "error")
    levels = OneHotEncoder.fit(seen)
    encoded = levels.apply(labels.apply(rows))

    seen = encoded.filter(train) if fit_on == "train" else encoded
    chosen = select_features(seen, LABEL, threshold, k, keep=(key, "split"), exclude=exclude)
    features = [c for c in chosen.columns if c not in (key, "split", LABEL)]
    table = encoded.select(key, *features, LABEL, "split")
    scaler = Standardizer.fit(table.filter(train), features)
    return Prepared(scaler.apply(table), features, scaler, split)


def data_quality(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(section, item, value): shape, nulls per column, rows and share per class, F score per column, and how many
    columns are effective (p < 0.05) and weak (p > 0.01).

    Columns without nulls are left out of the null section, constant columns out of the last two.
    """
    shape = profile(df).select(F.explode(F.create_map(
        F.lit("rows"), F.col("n_rows").cast("double"), F.lit("columns"), F.col("n_columns").cast("double"),
    )).alias("item", "value")).select(F.lit("shape").alias("section"), "item", "value")
    nulls = null_counts(df).filter(F.col("n_null") > 0).select(
        F.lit("missing").alias("section"), F.col("column").alias("item"), F.col("n_null").cast("double").alias("value")
    )
    counts = df.groupBy(F.col(label).cast("string").alias("item")).agg(F.count("*").cast("double").alias("value"))
    totals = counts.agg(F.collect_list(F.struct("item", "value")).alias("c"), F.sum("value").alias("n"))
    classes = totals.select("n", F.explode("c").alias("c")).select(
        F.explode(F.array(
            F.struct(F.lit("class_rows").alias("section"), F.col("c.item").alias("item"), F.col("c.value").alias("value")),
            F.struct(F.lit("class_share").alias("section"), F.col("c.item").alias("item"), (F.col("c.value") / F.col("n")).alias("value")),
        )).alias("r")
    ).select("r.*")
    report = shape.unionByName(nulls).unionByName(classes)
    cols = numeric_columns(df, [label])
    if not cols:
        return report
    tested = p_values(df, cols, label).agg(
        *validity_counts(), F.collect_list(F.when(~F.isnan("f"), F.struct("column", "f"))).alias("scores")
    )
    counts = [
        F.struct(F.lit("validity").alias("section"), F.lit(item).alias("item"), F.col(f"n_{item}").cast("double").alias("value"))
        for item in ("effective", "weak")
    ]
    scores = F.transform("scores", lambda s: F.struct(F.lit("f_score").alias("section"), s["column"].alias("item"), s["f"].alias("value")))
    return report.unionByName(tested.select(F.explode(F.concat(F.array(*counts), scores)).alias("r")).select("r.*"))
