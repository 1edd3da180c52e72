"""Contract and annotation tables, load counts and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pactum.operators.flatten import flat_annotations, full_text
from pactum.operators.ids import dense_ids
from pactum.session import scratch_path


# Every annotation column is NOT NULL.
ANNOTATION_REQUIRED = ("contract_id", "clause_type", "text", "start_char", "end_char")


def contracts_table(nested: DataFrame, ids: bool = True) -> DataFrame:
    """(id, title, full_text, contract_seq); ids 1..N in input order."""
    base = nested.select("contract_seq", "title", full_text(F.col("paragraphs")).alias("full_text"))
    if not ids:
        return base.withColumn("id", (F.col("contract_seq") + 1).cast("bigint"))
    return dense_ids(base, ["contract_seq"], "id")


def annotations_table(nested: DataFrame, contract_id_col: str = "contract_id",
                      check_text: bool = False) -> DataFrame:
    """(id, contract_id, clause_type, text, start_char, end_char) with ids 1..M in
    contract -> paragraph -> QA -> answer order (S7).  The contract id is carried
    through the explode, so no title join (J1) is needed.  ``check_text`` adds
    the ``text_matches`` report column (computed inside each contract row)."""
    flat = flat_annotations(nested, keep=["contract_seq", contract_id_col], check_text=check_text)
    # Flattened once: both the sampling of the ranges and their shuffle read the stored rows.
    path = scratch_path(nested.sparkSession, "annotations")
    flat.write.parquet(path)
    flat = nested.sparkSession.read.schema(flat.schema).parquet(path)
    with_ids = dense_ids(flat, ["contract_seq", "para_idx", "qa_idx", "ans_idx"], "id")
    return with_ids.select(
        "id", F.col(contract_id_col).cast("bigint").alias("contract_id"), "clause_type", "text",
        "start_char", "end_char", *(["text_matches"] if check_text else []))


def load_counts(nested: DataFrame) -> DataFrame:
    """A4: one row of load counts from a single pass over nested rows (no explode)."""
    qas = lambda p: p["qas"]
    n_qas = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda acc, p: acc + F.size(qas(p)))
    n_impossible = F.aggregate(
        "paragraphs", F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.size(F.filter(qas(p), lambda q: F.coalesce(q["is_impossible"], F.lit(False)))))
    n_ann = F.aggregate(
        "paragraphs", F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.aggregate(
            F.filter(qas(p), lambda q: ~F.coalesce(q["is_impossible"], F.lit(False))),
            F.lit(0).cast("bigint"), lambda a2, q: a2 + F.size(q["answers"])))
    return nested.agg(
        F.count(F.lit(1)).alias("n_contracts"),
        F.sum(F.size("paragraphs").cast("bigint")).alias("n_paragraphs"),
        F.sum(n_qas).alias("n_qas"),
        F.sum(n_impossible).alias("n_impossible_qas"),
        F.sum(n_ann).alias("n_annotations"),
    )


#: Reasons for which a load sets a contract aside.
SKIP_REASONS = ("not_an_object", "no_paragraphs", "paragraphs_not_a_list", "bad_paragraph", "bad_title")


def load_counted(flagged: DataFrame, path: str) -> dict[str, int]:
    """A4: writes the valid contracts of ``validate``'s rows to ``path`` and returns
    the counts of that same pass: contracts read, loaded and skipped, by reason,
    and annotations loaded.  The rows are observed in the stage that writes, whose
    tasks Spark counts once each, also when they are tried again."""
    n_ann = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda acc, p: acc + F.aggregate(
        F.filter(p["qas"], lambda q: ~F.coalesce(q["is_impossible"], F.lit(False))),
        F.lit(0).cast("bigint"), lambda a2, q: a2 + F.size(q["answers"])))
    ok = F.col("status") == "ok"
    seen = Observation()
    (flagged.observe(seen, F.count(F.lit(1)).alias("n_read"), F.count_if(ok).alias("n_loaded"),
                     F.count_if(~ok).alias("n_skipped"),
                     *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in SKIP_REASONS],
                     F.coalesce(F.sum(F.when(ok, n_ann)), F.lit(0)).alias("n_annotations"))
     .where(ok).select("contract_seq", "title", "paragraphs").write.mode("overwrite").parquet(path))
    return seen.get


def duplicate_titles(contracts: DataFrame) -> DataFrame:
    """A3: titles held by more than one contract (the build must fail on any)."""
    return contracts.groupBy("title").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphan_annotations(annotations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Annotations whose contract id is not in the contracts table."""
    return annotations.join(contracts.select(F.col("id").alias("contract_id")), "contract_id", "left_anti")


def integrity_report(contracts: DataFrame, annotations: DataFrame) -> DataFrame:
    """(check_name, n_checked, n_violations) for title uniqueness (A3), the
    foreign key (J11) and span text; every check is a distributed aggregate.
    ``annotations`` must carry ``text_matches`` (``annotations_table(...,
    check_text=True)``), so the corpus is flattened once for all checks."""
    def one_row(name: str, checked: DataFrame, bad: DataFrame) -> DataFrame:
        # Both are one-row global aggregates: combine as scalar subqueries.
        return checked.select(F.lit(name).alias("check_name"), "n_checked",
                              bad.select("n_violations").scalar().alias("n_violations"))

    n_contracts = contracts.agg(F.count(F.lit(1)).alias("n_checked"))
    dup = duplicate_titles(contracts).agg(F.count(F.lit(1)).alias("n_violations"))
    n_ann = annotations.agg(F.count(F.lit(1)).alias("n_checked"))
    orphans = orphan_annotations(annotations, contracts).agg(F.count(F.lit(1)).alias("n_violations"))
    any_null = F.lit(False)
    for c in ANNOTATION_REQUIRED:
        any_null = any_null | F.col(c).isNull()
    spans = annotations.agg(F.count(F.lit(1)).alias("n_checked"),
                            F.count_if(~F.col("text_matches")).alias("n_violations"),
                            F.count_if(any_null).alias("n_null"))
    return (one_row("duplicate_title", n_contracts, dup)
            .unionByName(one_row("orphan_annotation", n_ann, orphans))
            .unionByName(spans.select(F.lit("span_text_mismatch").alias("check_name"),
                                      "n_checked", "n_violations"))
            .unionByName(spans.select(F.lit("null_field").alias("check_name"), "n_checked",
                                      F.col("n_null").alias("n_violations"))))


def committed(spark, *paths: str) -> bool:
    """Do all these folders carry the commit marker of a finished write?"""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    markers = [jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS") for p in paths]
    return all(m.getFileSystem(hconf).exists(m) for m in markers)


def is_complete(spark, out_dir: str) -> bool:
    """Are both tables of a build there?  A half-finished build is not."""
    return committed(spark, f"{out_dir}/contracts", f"{out_dir}/annotations")


def write_tables(contracts: DataFrame, annotations: DataFrame, out_dir: str,
                 overwrite: bool = False) -> dict:
    """Write both tables, failing before any write on duplicate titles
    (all of them are listed in ``<out_dir>/duplicate_titles``) or null fields.
    Without ``overwrite`` a complete build is kept, without any work."""
    spark = contracts.sparkSession
    if not overwrite and is_complete(spark, out_dir):
        return {"skipped": True}
    dups = duplicate_titles(contracts)
    some = [r["title"] for r in dups.limit(3).collect()]
    if some:
        dups.write.mode("overwrite").parquet(f"{out_dir}/duplicate_titles")
        raise ValueError(f"duplicate contract titles, such as {some}; all are in {out_dir}/duplicate_titles")
    nulls = contracts.filter(F.col("title").isNull() | F.col("full_text").isNull()).limit(1).count()
    if nulls:
        raise ValueError("contracts with a null title or full_text")
    ann_null = F.lit(False)
    for c in ANNOTATION_REQUIRED:
        ann_null = ann_null | F.col(c).isNull()
    if annotations.filter(ann_null).limit(1).count():
        raise ValueError("annotations with a null field (all columns are NOT NULL)")
    contracts.select("id", "title", "full_text").write.mode("overwrite").parquet(f"{out_dir}/contracts")
    annotations.write.mode("overwrite").parquet(f"{out_dir}/annotations")
    return {"skipped": False}
