"""Verification: provenance audit, count alignment, state reconciliation, leakage, completeness, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.constants import AUDIT_STATUSES, COMPONENTS, SPLITS
from linewright.functions.text import classify_param, round_n


class CheckFailed(ValueError):
    """A verification gate did not hold."""


# --- provenance audit -----------------------------------------------------------------------------------------


def join_sidecars(log: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Metrics rows with the sidecar of their (model, split), if any. `sidecars` has at most one row per pair."""
    return log.join(sidecars, ["model", "split"], "left")


def flag_stale(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add `ckpt_missing`: a checkpoint path is recorded but no such file is listed."""
    present = files.select(F.col("path").alias("_file")).distinct()
    joined = rows.join(present, F.col("checkpoint_path") == F.col("_file"), "left")
    gone = F.col("checkpoint_path").isNotNull() & (F.col("checkpoint_path") != "") & F.col("_file").isNull()
    return joined.withColumn("ckpt_missing", gone).drop("_file")


def provenance_status(log_phantom: Column, has_meta: Column, meta_phantom: Column, ckpt_missing: Column) -> Column:
    """Phantom outranks stale; without a sidecar only the log's own phantom flag counts."""
    return (
        F.when(~has_meta & (F.lower(F.trim(log_phantom)) == "true"), "phantom")
        .when(~has_meta, "no_meta")
        .when(F.lower(meta_phantom) == "true", "phantom")
        .when(ckpt_missing, "stale")
        .otherwise("ok")
    )


def provenance_audit(log: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Status and notes per metrics row.

    `sidecars` has `model`, `split`, `meta_phantom`, `checkpoint_path`, `bad_head`, `readable`; `files` lists paths.
    """
    joined = flag_stale(join_sidecars(log, sidecars.withColumn("has_file", F.lit(True))), files)
    has_file = F.coalesce("has_file", F.lit(False))
    has_meta = has_file & F.coalesce("readable", F.lit(False))
    csv_phantom = F.coalesce(F.lower(F.trim("phantom")), F.lit("")) == "true"
    meta_phantom = F.coalesce("meta_phantom", F.lit(""))
    notes = F.array_compact(
        F.array(
            F.when(~has_file & csv_phantom, "log says phantom but there is no sidecar"),
            F.when(has_file & ~has_meta, "unreadable sidecar"),
            F.when(
                has_meta & (F.lower(meta_phantom) == "true"),
                F.concat(F.lit("head weights not restored: "), F.coalesce("bad_head", F.lit(0)).cast("string")),
            ),
            F.when(has_meta & F.col("ckpt_missing"), F.concat(F.lit("checkpoint missing on disk: "), "checkpoint_path")),
        )
    )
    # An unreadable sidecar leaves the row at no_meta whatever the log's own flag says.
    status = F.when(has_file & ~has_meta, "no_meta").otherwise(
        provenance_status(F.coalesce("phantom", F.lit("")), has_meta, meta_phantom, F.col("ckpt_missing"))
    )
    return joined.withColumns({"status": status, "notes": notes})


def status_counts(audited: DataFrame) -> DataFrame:
    """Rows per status, every status listed."""
    counted = audited.agg(*[F.count_if(F.col("status") == s).alias(s) for s in AUDIT_STATUSES])
    return counted.unpivot([], list(AUDIT_STATUSES), "status", "n")


def require_no_phantom(audited: DataFrame) -> None:
    n = audited.agg(F.count_if(F.col("status") == "phantom").alias("n")).first()["n"]
    if n:
        raise CheckFailed(f"{n} phantom rows")


# --- alignment of reported and expected counts ----------------------------------------------------------------


def distinct_splits(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("split", F.lit("test")).alias("split")).distinct().orderBy("split")


def expected_counts(pairs: DataFrame, splits: tuple[str, ...] = ()) -> DataFrame:
    """Scorable pairs per split. `splits` are those that have a label file: without any usable pair they count 0."""
    counted = pairs.groupBy("split").agg(F.count("*").alias("expected_pairs"))
    if not splits:
        return counted
    listed = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split"))
    return listed.join(counted, "split", "left").withColumn("expected_pairs", F.coalesce("expected_pairs", F.lit(0)))


def alignment_mismatches(log: DataFrame, expected: DataFrame, known: tuple[str, ...] = SPLITS) -> DataFrame:
    """Log rows whose `n` differs from the expected count of their split.

    A blank `n` counts as 0; a row with an unreadable `n`, or of a blank or unknown split, is passed over. Only a log
    without the column `split` is one of test rows.
    """
    split = F.col("split") if "split" in log.columns else F.lit("test")
    blank = F.coalesce(F.col("n").cast("string"), F.lit("")) == ""
    # Signs, blanks around and digit grouping are accepted; fractions are not whole counts.
    written = F.regexp_replace(F.trim(F.col("n").cast("string")), r"(?<=\d)_(?=\d)", "")
    reported = F.when(blank, F.lit(0)).when(written.rlike(r"^[+-]?\d+$"), written.try_cast("long"))
    rows = log.select("model", split.alias("split"), reported.alias("reported_n"))
    return (
        rows.where(F.col("reported_n").isNotNull() & F.col("split").isin(*known))
        # at most one row per known split, so the log stays where it is
        .join(F.broadcast(expected.where(F.col("split").isin(*known))), "split")
        .where("reported_n <> expected_pairs")
        .select("model", "split", "reported_n", "expected_pairs")
    )


def first_mismatches(mismatches: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n mismatches, and on each row how many more there are."""
    total = mismatches.agg(F.count("*")).scalar()
    return mismatches.orderBy(*order).limit(n).withColumn("more", F.greatest(total - n, F.lit(0)))


def require_alignment(mismatches: DataFrame) -> None:
    n = mismatches.count()
    if n:
        raise CheckFailed(f"{n} rows report a count that differs from the label files")


# --- parameter state ------------------------------------------------------------------------------------------


def reconcile(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of two key-to-shape tables as restored, missing, shape_mismatch or extra."""
    a = wanted.select("key", F.col("shape").alias("wanted_shape"), F.lit(True).alias("wanted"))
    b = found.select("key", F.col("shape").alias("found_shape"), F.lit(True).alias("found"))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("wanted").isNull(), "extra")
        .when(F.col("wanted_shape") == F.col("found_shape"), "restored")
        .otherwise("shape_mismatch")
    )
    return a.join(b, "key", "full_outer").select(
        "key", "wanted_shape", "found_shape", status.alias("status"), classify_param(F.col("key")).alias("component")
    )


def component_counts(reconciled: DataFrame) -> DataFrame:
    """Keys per status and component; a status without keys of a component has 0."""
    return reconciled.groupBy("status").agg(*[F.count_if(F.col("component") == c).alias(c) for c in COMPONENTS])


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    s = F.col("status")
    return reconciled.agg(
        F.count_if(s != "extra").alias("n_wanted"),
        F.count_if(s != "missing").alias("n_found"),
        F.count_if(s == "restored").alias("n_restored"),
        F.count_if(s == "missing").alias("n_missing"),
        F.count_if(s == "shape_mismatch").alias("n_shape_mismatch"),
        F.count_if(s == "extra").alias("n_extra"),
        F.count_if((s == "missing") & (F.col("component") == "head")).alias("head_missing"),
        F.count_if((s == "shape_mismatch") & (F.col("component") == "head")).alias("head_shape_mismatch"),
    )


def reconcile_sample(reconciled: DataFrame, status: str, n: int = 10) -> DataFrame:
    """The first n keys of a status."""
    return reconciled.where(F.col("status") == status).orderBy("key").limit(n)


def require_restored_head(reconciled: DataFrame, allow_head_reinit: bool = False) -> None:
    """Raise when a head weight is missing or of another shape, unless that is wanted."""
    row = reconcile_summary(reconciled).first()
    bad = row["head_missing"] + row["head_shape_mismatch"]
    if bad and not allow_head_reinit:
        raise CheckFailed(
            f"{bad} head weights not restored (missing={row['head_missing']}, mismatched={row['head_shape_mismatch']})"
        )


# --- splits, artifacts, inventory -----------------------------------------------------------------------------


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split. Min and max combine before the shuffle, so a hot key costs nothing."""
    return (
        rows.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count("*").alias("n"))
        .where("first_split <> last_split")
    )


def require_no_leak(rows: DataFrame, key: str) -> None:
    if leaks(rows, key).limit(1).count():
        raise CheckFailed(f"a value of {key} occurs in more than one split")


def completeness(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected artifacts with their item counts, and whether each is there. `found` has `path` and `items`."""
    return expected.join(found.groupBy("path").agg(F.sum("items").alias("items")), "path", "left").select(
        *expected.columns, F.coalesce("items", F.lit(0)).alias("items"), F.col("items").isNotNull().alias("present")
    )


def inventory(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines, parsed lines, missing images, usable pairs and lengths of the usable ones, in one pass.

    `lines` has `text` (NULL for a malformed line) and `has_image`.
    """
    parsed = F.col("text").isNotNull()
    usable = parsed & F.col("has_image")
    length = F.when(usable, F.length("text"))
    return lines.groupBy(*by).agg(
        F.count("*").alias("lines_in_file"),
        F.count_if(parsed).alias("tab_parsed_rows"),
        F.count_if(usable).alias("pairs_with_existing_image"),
        F.count_if(parsed & ~F.col("has_image")).alias("missing_image"),
        F.min(length).alias("char_len_min"),
        F.max(length).alias("char_len_max"),
        round_n(F.avg(length), 4).alias("char_len_mean"),
    )
