"""Document collections: mail, transcripts, file metadata, entities, redaction, types, comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.core import col, r, smallest_mode
from tessera.sources.scratch import settled

#: Patterns of the entities.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?:\+?\d{1,3}[ -.]?)?(?:\(?\d{2,4}\)?[ -.]?)?\d{3,4}[ -.]?\d{3,4}"
MONEY = r"\$?\d{1,3}(?:[,.]\d{3})*(?:\.\d+)?\s?(?:USD|EUR|GBP|ETB)?"
URL = r"https?://[\w./?=&%-]+"
DATE = r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
ADDRESS = r"(?i)\b\d+\s+[A-Za-z0-9.,'\-\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct)\b"
NAME = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"
ENTITIES = {"emails": EMAIL, "phones": PHONE, "money": MONEY, "urls": URL, "dates": DATE, "addresses": ADDRESS}

#: Document types by the first keyword set with a hit, with their confidence.
TYPES = (
    ("contract", ("contract", "agreement", "clause", "party", "warranty"), 0.95),
    ("resume", ("resume", "cv", "curriculum vitae", "education", "experience"), 0.95),
    ("research", ("research", "methodology", "results", "findings", "abstract"), 0.95),
    ("financial", ("invoice", "billing", "payment", "amount", "due"), 0.85),
    ("business", ("proposal", "project", "plan", "summary"), 0.80),
)
#: Goal categories by keyword.
GOALS = (("Reporting", ("loan", "portfolio")), ("Customer Handling", ("customer", "client")), ("Compliance", ("risk", "compliance")), ("Collections", ("overdue", "collection")))


def word_count(c: str | Column) -> Column:
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def mail_summary(df: DataFrame, sender: str = "from", to: str = "to", subject: str = "subject", body: str = "body", day: str = "date") -> DataFrame:
    per = df.groupBy(day).count()
    peak = per.agg(F.max_by(day, F.struct("count", day)).alias("peak_day"), r(F.avg("count")).alias("per_day"))
    urgent = F.concat_ws(" ", subject, body).rlike("(?i)urgent|important|asap")
    one = df.agg(F.count(F.lit(1)).alias("mails"), F.count_distinct(sender).alias("senders"), F.count_distinct(to).alias("recipients"), r(F.avg(F.length(subject))).alias("mean_subject"), F.count_if(urgent).alias("urgent"))
    return one.join(peak)


def transcript_summary(df: DataFrame, speaker: str = "speaker", text: str = "text", transcript: str = "transcript_id") -> DataFrame:
    """Per speaker: turns, words, mean length; the share of all turns."""
    per = df.groupBy(speaker).agg(F.count(F.lit(1)).alias("turns"), F.sum(word_count(text)).cast("long").alias("words"), r(F.avg(F.length(text))).alias("mean_length"), F.count_distinct(transcript).alias("transcripts"))
    return per.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).withColumn("share", r(F.col("turns") / F.col("_n"))).drop("_n")


def page_statistics(df: DataFrame, pages: str = "page_count", text: str = "text_content", size: str = "file_size", name: str = "filename") -> DataFrame:
    chars = F.length(F.coalesce(F.col(text), F.lit("")))
    density = chars / (F.col(pages) + 1e-4)
    return df.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(pages).cast("long").alias("pages"), r(F.avg(pages)).alias("mean_pages"), F.max(pages).cast("long").alias("max_pages"), F.min(pages).cast("long").alias("min_pages"),
        F.sum(chars).alias("chars"), F.count_if(chars == 0).alias("empty"), r(F.sum(size) / 1048576).alias("megabytes"), F.count_distinct(name).alias("names"), (F.count(name) - F.count_distinct(name)).alias("duplicate_names"),
        F.count_if(density > 100).alias("dense"), F.count_if((density >= 50) & (density <= 100)).alias("moderate"), F.count_if(density < 50).alias("sparse"),
    )


def image_statistics(df: DataFrame, width: str = "width", height: str = "height", size: str = "file_size") -> DataFrame:
    pixels = F.col(width).cast("long") * F.col(height)
    one = df.agg(
        r(F.avg(width)).alias("mean_width"), r(F.avg(height)).alias("mean_height"), r(F.sum(size) / 1024).alias("kilobytes"),
        F.count_if(pixels <= 307_200).alias("low"), F.count_if((pixels > 307_200) & (pixels <= 921_600)).alias("sd"), F.count_if((pixels > 921_600) & (pixels <= 2_073_600)).alias("hd"), F.count_if(pixels > 2_073_600).alias("uhd"),
    )
    return one.join(F.broadcast(smallest_mode(df, F.round(F.col(width) / F.col(height), 2), "modal_ratio")))


_WORD = "[0-9A-Za-z_]"


def in_ascii(pattern: str) -> str:
    """An entity's pattern with word ends and blanks of ASCII as RE2 has them; Java's word ends know accented letters, its blanks the vertical tab.

    A pattern with word ends has two, before a digit and behind a letter or digit. Without regard to case RE2 takes the long s
    and the Kelvin sign for s and k, which Java doesn't.
    """
    if pattern.startswith("(?i)"):
        pattern = pattern.replace("A-Za-z", "A-Za-z\u017f\u212a").replace("St", "[S\u017f]t")
    pattern = pattern.replace(r"\b", rf"(?=\d)(?<!{_WORD})", 1).replace(r"\b", f"(?!{_WORD})")
    return pattern.replace(r"\s", r"[\t\n\f\r ]")


def extract_entities(df: DataFrame, text: str = "text", kinds: Sequence[str] = tuple(ENTITIES)) -> DataFrame:
    """Adds an array of the distinct matches of each kind, in order; words are of ASCII letters, so one ends before an accented letter."""
    return df.withColumns({k: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(in_ascii(ENTITIES[k])), F.lit(0))) for k in kinds})


def redact(c: str | Column) -> Column:
    """Mails, phones, addresses, links and names replaced by their kind, in this order."""
    out = col(c)
    for kind, pattern in (("EMAIL", EMAIL), ("PHONE", PHONE), ("ADDRESS", ADDRESS), ("URL", URL), ("NAME", NAME)):
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return out


def script_language(c: str | Column) -> Column:
    text = col(c)
    return (
        F.when(text.rlike(r"[ሀ-፿]"), "Amharic").when(text.rlike(r"[Ѐ-ӿ]"), "Russian").when(text.rlike(r"[؀-ۿ]"), "Arabic")
        .when(text.rlike(r"[一-鿿]"), "Chinese").when(text.rlike(r"[ऀ-ॿ]"), "Hindi").otherwise("English")
    )


def document_type(c: str | Column) -> Column:
    """struct<type, confidence>."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    kind, sure = F.lit("general"), F.lit(0.60)
    for name, words, confidence in reversed(TYPES):
        hit = text.rlike("|".join(words))
        kind, sure = F.when(hit, name).otherwise(kind), F.when(hit, confidence).otherwise(sure)
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def goal_category(c: str | Column) -> Column:
    text, out = F.lower(col(c)), F.lit(None).cast("string")
    for name, words in reversed(GOALS):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def entity_ids(c: str | Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)(?:CUST|LOAN|DOC)\d+"), F.lit(0)), lambda x: F.upper(x)))


def collection_summary(df: DataFrame, text: str = "text") -> DataFrame:
    n = word_count(text)
    return df.agg(F.count(F.lit(1)).alias("documents"), F.sum(n).cast("long").alias("words"), r(F.avg(n)).alias("mean_words"), F.max(n).cast("long").alias("most_words"))


def section_diff(a: DataFrame, b: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """key, side, section: distinct sections that only the first (removed) or second (added) version has."""
    cut = lambda d: d.select(key, F.explode(F.split(text, separator)).alias("section")).select(key, F.trim("section").alias("section")).where("section != ''").distinct()
    old, new = cut(a), cut(b)
    gone = old.join(new, [key, "section"], "left_anti").withColumn("side", F.lit("removed"))
    return gone.unionByName(new.join(old, [key, "section"], "left_anti").withColumn("side", F.lit("added")))


def pair_similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ratio: 200 * matching characters over all characters, by longest matching blocks, to two places. Pairs are given, not made here."""
    from difflib import SequenceMatcher

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["ratio"] = [round(SequenceMatcher(None, x or "", y or "").ratio() * 100, 2) for x, y in zip(f[a], f[b], strict=True)]
            yield f

    return pairs.mapInPandas(ratio, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())]))


BANDS, BAND, ROUNDS = 16, 4, 4
BROADCAST_KEYS = 500_000  #: ids that may be sent to all tasks; more are joined by shuffle


def shingles(text: str | Column, k: int = 3) -> Column:
    """The distinct runs of ``k`` lower-cased words; the whole text where it has fewer."""
    words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))
        return F.array_distinct(F.when(F.size(w) >= k, each).otherwise(F.array(F.array_join(w, " "))))

    return F.transform(F.array(words), runs)[0]  # bound once: named in the inner function, the words would be split again for each run


def near_documents(df: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = 0.7, seed: int = 5) -> DataFrame:
    """key, near_id, overlap, ratio: each document that is nearly one with a smaller key, and that document.

    Nearly one: their sets of three-word shingles overlap (intersection over union) by ``at_least``. near_id is the first text among
    those found, ratio their similarity in percent by longest matching blocks. Of equal texts the smallest key stands for all; the
    others have it as near_id with 100.

    Candidates come from MinHash tables of BAND hashes each, BANDS of them. In a bucket all meet its smallest key, not each other;
    those it isn't like go on without it, for ROUNDS rounds, so the work grows with the members of buckets. Overlaps and ratios are exact.
    Null keys and texts are left out; a text without words is near to equal texts only.
    """
    from pyspark.ml.feature import HashingTF, MinHashLSH

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).withColumn("h", F.sha2("t", 256))
    texts = settled(rows.groupBy("h").agg(F.min("id").alias("rep"), F.first("t").alias("t")))
    rep = texts.select("h", "rep")
    copies = rows.select("id", "h").join(rep, "h").where("id != rep").select("id", F.col("rep").alias("near_id"), F.lit(1.0).alias("overlap"), F.lit(100.0).alias("ratio"))
    several = settled(rep.groupBy("rep").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not several.isEmpty():  # ids with several texts: one of them stands
        texts = settled(texts.join(several, "rep", "left").where("least is null or h = least").drop("least"))
    hashed = HashingTF(inputCol="set", outputCol="features", numFeatures=1 << 20, binary=True).transform(texts.where(F.trim("t") != "").select("rep", shingles("t").alias("set")))
    hashed = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=BANDS * BAND, seed=seed).fit(hashed).transform(hashed)
    keys = F.array(*[F.xxhash64(F.slice("hashes", i * BAND + 1, BAND), F.lit(i)) for i in range(BANDS)])
    todo, links = settled(hashed.select("rep", F.explode(keys).alias("key"))), None

    def with_texts(pairs: DataFrame) -> DataFrame:
        """Pairs (rep, centre) with their texts, b and a; only texts that are asked for are shuffled."""
        asked = settled(pairs.select("rep").unionByName(pairs.select(F.col("centre").alias("rep"))).distinct())
        few = texts.select("rep", "t").join(F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked, "rep", "left_semi")
        return pairs.join(few.withColumnRenamed("t", "b"), "rep").join(few.select(F.col("rep").alias("centre"), F.col("t").alias("a")), "centre")

    for _ in range(ROUNDS):
        buckets = todo.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = settled(todo.join(buckets, "key").select("key", "rep", "centre").where("rep != centre"))
        if met.isEmpty():
            break
        pairs = met.select("rep", "centre").distinct()
        sets = with_texts(pairs).select("rep", "centre", shingles("b").alias("set"), shingles("a").alias("other"))
        pairs = sets.select("rep", "centre", F.size(F.array_intersect("set", "other")).alias("both"), (F.size("set") + F.size("other")).alias("all"))
        overlap = F.col("both") / (F.col("all") - F.col("both"))
        found = settled(pairs.select("rep", "centre", overlap.alias("overlap")).where(F.col("overlap") >= at_least))
        links = found if links is None else links.unionByName(found)
        todo = settled(met.join(found.select("rep").distinct(), "rep", "left_anti").select("rep", "key"))
    if links is None:
        return copies.withColumnRenamed("id", key)
    best = links.groupBy("rep").agg(F.min(F.struct("centre", "overlap")).alias("best")).select("rep", "best.*")
    best = with_texts(settled(best))
    best = pair_similarity(best).select(F.col("rep").alias("id"), F.col("centre").alias("near_id"), "overlap", "ratio")
    return best.unionByName(copies).withColumnRenamed("id", key)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def mail_leaders(df: DataFrame, sender: str = "from", to: str = "to", sentiment: str = "sentiment", top: int = 5) -> DataFrame:
    """kind, label, n: the most frequent senders and recipients, and all sentiments."""

    def counts(c: str, kind: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "label", "n")

    most = [counts(c, kind).orderBy(F.desc("n"), "label").limit(top) for c, kind in ((sender, "sender"), (to, "recipient"))]
    return most[0].unionByName(most[1]).unionByName(counts(sentiment, "sentiment"))


def transcript_content(df: DataFrame, text: str = "text", minutes: str = "duration_minutes") -> DataFrame:
    """One row: mean length and words of the texts; mean, longest and shortest duration."""
    return df.agg(
        r(F.avg(F.length(text))).alias("mean_length"), F.sum(word_count(text)).cast("long").alias("words"),
        r(F.avg(minutes)).alias("mean_minutes"), r(F.max(minutes)).alias("longest"), r(F.min(minutes)).alias("shortest"),
    )


def deck_statistics(df: DataFrame, slides: str = "slide_count", text: str = "text_content", notes: str = "speaker_notes") -> DataFrame:
    """One row: decks, slides, text per slide (mean text over mean slides), decks with notes, characters, mean text."""
    size = F.avg(F.length(text))
    return df.agg(
        F.count(F.lit(1)).alias("decks"), F.sum(slides).cast("long").alias("slides"), r(F.avg(slides)).alias("mean_slides"), r(size / F.when(F.avg(slides) > 0, F.avg(slides)).otherwise(1)).alias("text_per_slide"),
        F.count(notes).alias("with_notes"), F.sum(F.length(text)).alias("chars"), r(size).alias("density"),
    )


def collection_languages(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: the sorted script languages of all texts."""
    return df.where(F.col(text).isNotNull()).select(script_language(text).alias("_l")).distinct().agg(F.sort_array(F.collect_set("_l")).alias("languages"))
