"""A corpus pipeline: language, near copies, benchmark leaks, secrets, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written and read
again. All but the last return the columns of ``docs``, which may have more than those of documents, of any name.
Whole texts are read, whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import decontaminate, groups, jaccard, langid, mixing, secrets
from halocline.llm.workspace import Workspace, fresh, table

#: The least share of a text's n-grams that its language must know. Texts below it are in no language learned.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no known language, go; the others' lang is the language found.

    A null text has no letter. Of equally likely languages the first by name is taken; repeated rows stay, each judged
    alike. Without any labelled text no language is known, and all documents go.
    """
    (out,) = fresh(docs, "found_language")
    found = langid.predict(docs, langid.fit(docs), out=out)
    known = (F.col(f"{out}.lang") != langid.UNDETERMINED) & (F.col(f"{out}.score") >= LEAST_LANGUAGE)
    return found.filter(known).withColumn("lang", F.col(f"{out}.lang")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join one stays: with the smallest doc_id, null last, then the smallest digest of the text.

    Of repeated rows of it one stays, whichever. Documents without words, null texts among them, are no copies: all stay.
    """
    work = Workspace(spark, "near_copies")
    key, at, first, n, mark = fresh(docs, "text_key", "id_hash", "first_id", "copies_n", "marked")
    judged = jaccard.join_similar(docs).filter("text_key is not null").groupBy("text_key", F.col("doc_id").alias(first)).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias(n))
    judged = work.write(judged.select(F.col("text_key").alias(key), F.xxhash64(first).alias(at), first, n, "kept"), "judged")
    kept = judged.filter("kept").drop("kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumns({key: F.when(worded, F.unhex(F.md5(F.col("text").cast("binary")))), at: F.xxhash64("doc_id")})
    # texts that stay, and of which there is one row, need not be sent anywhere
    keyed = groups.marked(keyed, judged.filter(~F.col("kept") | (F.col(n) > 1)), [key, at], mark)
    sent = F.col(key).isNotNull() & F.col(mark)
    stay = groups.join_counted(keyed.filter(sent), kept, [key, at], n, groups.rows_of(kept, n)).filter(F.col("doc_id").eqNullSafe(F.col(first)))
    return stay.dropDuplicates([key, at]).select(docs.columns).unionByName(keyed.filter(~sent).select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go, all that have the same text.

    Null and wordless texts and items match nothing. Repeated rows go or stay together.
    """
    work = Workspace(spark, "leaks")
    (key,) = fresh(docs, "text_key")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    return groups.join_spread(keyed, work.write(leaks, "leaks"), [key], "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text become a mark, overlapping ones one mark; n_chars follows the text where it changes.

    All documents stay, a null text as it is; repeated rows are redacted alike.
    """
    (out,) = fresh(docs, "secret_spans")
    found = secrets.find_secrets(docs, out=out)
    text = secrets.redact(F.col("text"), F.col(out))
    chars = F.when(F.size(out) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", chars).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of ``copies``; those that it does not take go.

    A null source is a source, a null text has no words and is taken by the whole part of its source's ratio. Repeated
    rows are settled one by one; which of them takes a copy more than the others makes no difference. A column
    ``copies`` of ``docs`` is replaced.
    """
    work = Workspace(spark, "mix_sources")
    size, digest, match, low, high, n, most, place = fresh(docs, "words", "text_hash", "row_hash", "least", "greatest", "rows_n", "rows_more", "place")
    names = fresh(docs.select("*", *[F.lit(0).alias(c) for c in (size, digest, match, low, high, n, most, place)]), "mix_id", "mix_source", "mix_size", "mix_hash")
    taken = mixing.mix(docs).groupBy(*mixing.KEY).agg(F.min("copies").alias(low), F.max("copies").alias(high), F.sum("n").alias(n), F.max_by("n", "copies").alias(most))
    taken = taken.filter(F.col(high) > 0).withColumn(match, F.xxhash64(*mixing.KEY))
    taken = work.write(taken.select(match, *[F.col(c).alias(a) for c, a in zip(mixing.KEY, names, strict=True)], low, high, n, most), "taken")
    keyed = docs.withColumns({size: mixing.count_words(F.col("text")), digest: F.xxhash64("text")})
    keyed = keyed.withColumn(match, F.xxhash64("doc_id", "source", size, digest))
    found = groups.join_counted(keyed, taken, [match], n, groups.rows_of(taken, n))
    for c, a in zip(("doc_id", "source", size, digest), names, strict=True):
        found = found.filter(F.col(c).eqNullSafe(F.col(a)))
    columns = [c for c in docs.columns if c != "copies"]
    alike = found.filter(F.col(low) == F.col(high)).select(*columns, F.col(high).alias("copies"))
    apart = taken.filter(F.col(low) < F.col(high))
    if apart.isEmpty():
        return alike
    uneven = work.write(found.filter(F.col(low) < F.col(high)).select(*columns, match, low, high, most), "uneven")
    uneven = groups.numbered(uneven, [match], place, work).withColumn("copies", F.when(F.col(place) <= F.col(most), F.col(high)).otherwise(F.col(low)))
    return alike.unionByName(uneven.filter("copies > 0").select(*columns, "copies"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_leaks),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: Hash draws and random paths are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{i}")
        work.keep(f"stage{i}")
    return docs
