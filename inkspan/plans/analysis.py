"""The document pass: pages, pattern detections and those of an optional model, occurrences, folding, joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.operators import detectors, redact, spans
from inkspan.sources.text import read_pages

COLUMNS = ["doc_id", "page", "category", "confidence", "start", "end", "text", "reason", "everywhere"]


def analyze(docs: DataFrame, model: DataFrame | None = None, preset: str = "everything", verdicts: DataFrame | None = None) -> DataFrame:
    """Detections of documents (doc_id, text) by page: patterns, a model's rows (COLUMNS), every place of what is global,
    without repeats, neighbours of both origins joined; a page is read in its document's language. Verdicts (doc_id, page, start, end, sensitive, new_confidence) settle
    the shaky ones first. Redactions made of them are suggested, never accepted. Documents
    over the limit of ``read_pages``, which names them, have none, and the others go on."""
    pages, _ = read_pages(docs.select("doc_id", "text", detectors.text_languages(F.col("text")).alias("languages")), keep="languages")
    found = detectors.narrow(detectors.detect(pages, languages="languages"), preset)
    if verdicts is not None:
        shaky, solid = detectors.split_by_confidence(found)
        found = solid.unionByName(detectors.merge_verdicts(shaky, verdicts, ["doc_id", "page", "start", "end"]).select(*solid.columns))
    patterns = found.select(*COLUMNS, "seq").withColumn("_from", F.lit("patterns"))
    rows = patterns if model is None else patterns.unionByName(model.select(*COLUMNS).withColumn("seq", F.lit(1 << 18)).withColumn("_from", F.lit("model")))
    more = spans.expand_occurrences(rows, pages).withColumn("seq", F.lit(1 << 20)).withColumn("_from", F.lit(None).cast("string"))
    every = spans.dedupe(rows.unionByName(more))
    if model is None:
        return every.select(*COLUMNS)
    norm = spans.normalize_value(F.col("text"))
    origin = rows.select("doc_id", "category", norm.alias("_n"), "_from").distinct().groupBy("doc_id", "category", "_n").agg(F.collect_set("_from").alias("sources"))
    marked = every.withColumn("_n", norm).join(origin, ["doc_id", "category", "_n"], "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return spans.join_adjacent(marked, pages)


def to_redactions(detections: DataFrame) -> DataFrame:
    """Suggested text redactions of a detector."""
    return detections.withColumns({"status": F.lit("suggested"), "source": F.lit("ai"), "type": F.lit("text"), "method": F.lit(None).cast("string")})


def export(pages: DataFrame, redactions: DataFrame, refuse: bool = True) -> dict[str, DataFrame]:
    """Redacted pages (doc_id, page, redacted_text), vaults and surrogates; raises if an accepted value is still there."""
    named = redact.surrogates(redactions)
    own = redact.accepted(redactions).withColumn("normalized", spans.normalize_value(F.col("text")))
    ranges = own.join(named.select("doc_id", "normalized", F.col("surrogate").alias("replacement")), ["doc_id", "normalized"], "left")
    values = redact.accepted_values(redactions)
    swept = spans.expand_occurrences(values.select("doc_id", F.col("value").alias("text"), F.lit("other").alias("category"), F.lit("").alias("reason"), F.lit(True).alias("everywhere"), F.lit(0).alias("seq")), pages, standalone=False)
    swept = swept.withColumn("normalized", spans.normalize_value(F.col("text"))).join(named.select("doc_id", "normalized", F.col("surrogate").alias("replacement")), ["doc_id", "normalized"], "left")
    cols = ["doc_id", "page", "start", "end", "replacement"]
    out = redact.cut_text(pages, ranges.select(*cols).unionByName(swept.select(*cols)), ["doc_id", "page"])
    if refuse:
        redact.assert_clean(redact.verify(out.select("doc_id", F.col("redacted_text").alias("text")), values, named))
    return {"pages": out.select("doc_id", "page", "redacted_text"), "vaults": redact.vault(named), "surrogates": named}
