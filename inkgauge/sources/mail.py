"""Mail folders as DataFrames: .eml and maildir trees file by file, mbox files message by message."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .archives import mbox_messages, tar_members

SCHEMA = "path string, message_id string, sent timestamp, from_name string, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, body string, in_reply_to string, reference_ids array<string>"


def body_of(message) -> str:
    """First plain part that isn't an attachment, else the first HTML part without tags; unknown bytes replaced."""
    html = ""
    for part in message.walk():
        if part.get_content_maintype() != "text" or part.get_content_disposition() == "attachment":
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            text = raw.decode("utf-8", "replace")
        if part.get_content_subtype() == "plain":
            return text
        html = html or text
    return re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", html)).strip()


def row_of(path: str, raw: bytes) -> tuple:
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    decoded = lambda name: str(email.header.make_header(email.header.decode_header(m.get(name, "") or "")))
    every = lambda name: [a.lower() for _, a in email.utils.getaddresses(m.get_all(name, [])) if a]
    try:
        sent = pd.Timestamp(email.utils.parsedate_to_datetime(m["Date"])).tz_convert("UTC").tz_localize(None) if m["Date"] else None
    except (TypeError, ValueError):
        sent = None
    name, address = email.utils.parseaddr(m.get("From", ""))
    return path, m.get("Message-ID", "").strip(), sent, name, address.lower(), every("To"), every("Cc"), decoded("Subject"), body_of(m), m.get("In-Reply-To", "").strip(), re.findall(r"<[^>]+>", m.get("References", ""))


def _parsed(files: DataFrame) -> DataFrame:
    """Messages of path and content, in batches of bounded size whatever the messages hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows, size = [], 0
            for path, raw in zip(b["path"], b["content"], strict=True):
                rows.append(row_of(path, bytes(raw)))
                size += len(raw)
                if size > 1 << 24:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_eml(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder))


def read_mbox(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of .mbox files (also .mbox.gz), which many tasks share."""
    return _parsed(mbox_messages(spark, folder))


def read_maildir(spark: SparkSession, folder: str, sent_only: bool = True) -> DataFrame:
    """Adds owner and folder from .../maildir/owner/folder/...; other paths have neither and go if sent_only.

    Spark's listing hides folders whose names begin with an underscore; name those in the path itself.
    """
    return _owners(_parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)), sent_only)


def _owners(m: DataFrame, sent_only: bool) -> DataFrame:
    at = F.regexp_extract("path", r"maildir/([^/]+)/([^/]+)/", 1)
    m = m.withColumn("owner", F.when(at != "", at)).withColumn("folder", F.lower(F.regexp_extract("path", r"maildir/([^/]+)/([^/]+)/", 2)))
    return m.where(F.col("folder").isin("sent", "sent_items", "_sent_mail", "sent items")) if sent_only else m


WORD_FLOOR = {"mail": 5, "segments": 10, "corpus": 20}


def recent(messages: DataFrame, months_back: int, as_of: str, time_col: str = "sent") -> DataFrame:
    """Messages of the last months of 30 days before as_of; undated ones stay."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(30 * months_back))
    return messages.where(F.col(time_col).isNull() | (F.col(time_col) >= cutoff))


def long_enough(messages: DataFrame, least: int, body_col: str = "body") -> DataFrame:
    return messages.where(F.size(T.fields(F.coalesce(body_col, F.lit("")))) >= least)


def own_mail(messages: DataFrame, months_back: int = 12, as_of: str | None = None) -> DataFrame:
    """Messages as a profile takes them: recent, without quotes and signatures, of five words or more."""
    rows = recent(messages, months_back, as_of) if as_of else messages
    return long_enough(rows.withColumn("body", T.strip_quotes(F.col("body"))), WORD_FLOOR["mail"])


def of_accounts(messages: DataFrame, accounts: list[str], owner: str = "owner") -> DataFrame:
    """Messages whose owner's name holds one of accounts, whatever its case; all of them without any."""
    low = F.lower(F.coalesce(owner, F.lit("")))
    return messages.where(F.exists(F.array(*[F.lit(a.lower()) for a in accounts]), lambda a: low.contains(a))) if accounts else messages


def enough(messages: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Messages of the keys that have at least `least` of them. Counts are joined, so that a frequent key is no single task."""
    held = messages.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return messages.join(held, key, "left_semi")


def labelled(own: DataFrame, others: list[DataFrame], body: str = "body", least: int = 20) -> DataFrame:
    """A training set: doc_id (digest of the text), body and label, 1 for texts of own and 0 for those of others.

    Texts of fewer words go; of equal texts one stays, of own if it is among them; an id is the same in every run.
    """
    parts = [df.select(F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"), F.lit(y).alias("label")) for y, dfs in ((1.0, [own]), (0.0, others)) for df in dfs]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return long_enough(rows, least).groupBy("body").agg(F.max("label").alias("label")).select(F.xxhash64("body").alias("doc_id"), "body", "label")


def exported_mail(messages: DataFrame, least_chars: int = 20) -> DataFrame:
    """Messages as an archive's export keeps them: no bulk mail, plain characters, no replies and signatures; replies and forwards told apart."""
    kept = messages.where(~T.is_bulk(F.col("subject"), F.col("body")))
    clean = kept.withColumn("body", T.strip_signature(T.strip_replies(T.unformatted(T.html_spaced(F.coalesce("body", F.lit("")))))))
    low = F.lower(F.coalesce("subject", F.lit("")))
    return clean.where(F.length("body") >= least_chars).withColumns({"is_reply": low.startswith("re:"), "is_forward": low.startswith("fw:") | low.startswith("fwd:"), "word_count": F.size(T.fields(F.col("body"))), "char_count": F.length("body")})


def capped(messages: DataFrame, key: str, most: int, time_col: str = "sent", id_col: str = "message_id") -> DataFrame:
    """The newest most messages of each key; ties by id."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(time_col), id_col))
    return messages.withColumn("__r", r).where(F.col("__r") <= most).drop("__r")


CORPUS_FIELDS = {"body": ("body", "body_text", "text"), "subject": ("subject",), "to": ("to", "recipient"), "date": ("date", "sent_date")}
SEGMENT_FIELDS = {"text": ("text", "body"), "source_id": ("source_id", "id"), "title": ("title",), "date": ("date",), "speaker": ("speaker",)}


def _objects(values: DataFrame) -> DataFrame:
    """v: the objects of parsed JSON values, which are objects, arrays of them, or objects that hold them as messages and emails."""
    array = lambda path: F.try_variant_get("v", path, "array<variant>")
    held = F.concat(*[F.coalesce(array(f"$.{c}"), F.array().cast("array<variant>")) for c in ("messages", "emails")])
    each = F.when(F.schema_of_variant("v").startswith("ARRAY"), array("$")).when(F.size(held) > 0, held).otherwise(F.array("v"))
    return values.where("v is not null").select(F.explode(each).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def _fields(objects: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    return objects.select("*", *[F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names]).alias(name) for name, names in fields.items()])


def read_corpus(spark: SparkSession, path: str, min_words: int = 20, lines: bool | None = None) -> DataFrame:
    """Messages of JSON files, of any of the usual field names: body, subject, to, date.

    A file holds an object a line, an array, or an object with messages or emails. lines says which of all files; without
    it each file is judged by itself: it is one of lines if every line that isn't blank is a whole object or array. Values
    that aren't objects have no messages.
    """
    read = lambda at, whole: spark.read.option("recursiveFileLookup", "true").text(at, wholetext=whole)
    by_line = read(path, False).where("trim(value) <> ''").withColumn("v", F.try_parse_json("value"))
    if lines is None:
        whole_value = F.coalesce(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"), F.lit(False))
        judged = by_line.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(whole_value).alias("lines"))
        # as many rows as files, of which Spark's own listing is on the driver too
        files = [(r.path, r.lines) for r in judged.collect()]
        parts = [read([f for f, is_lines in files if is_lines == kind], not kind) for kind in (True, False) if any(is_lines == kind for _, is_lines in files)]
        rows = [p.where("trim(value) <> ''").select(F.try_parse_json("value").alias("v")) for p in parts]
        values = rows[0].unionByName(rows[1]) if len(rows) == 2 else rows[0] if rows else by_line.select("v").limit(0)
    else:
        values = by_line.select("v") if lines else read(path, True).select(F.try_parse_json("value").alias("v"))
    return long_enough(_fields(_objects(values), CORPUS_FIELDS).drop("v"), min_words)


def read_segments(spark: SparkSession, path: str, min_words: int = 10) -> DataFrame:
    """Segments of a JSON array of strings or objects: text cleaned of time stamps and speakers; ids default to their place."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = whole.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("place", "v"))
    rows = _fields(each.withColumn("place", F.col("place").cast("string")), SEGMENT_FIELDS)
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    return _segments(rows.withColumn("text", F.when(is_object, F.col("text")).otherwise(F.try_variant_get("v", "$", "string"))), min_words)


def from_texts(spark: SparkSession, texts: list[str], source_ids: list[str] | None = None, titles=None, dates=None, speakers=None, min_words: int = 10) -> DataFrame:
    """Segments of a list in memory; those of fewer words go."""
    at = lambda xs, i: xs[i] if xs and i < len(xs) else None
    rows = [(str(i), t, at(source_ids, i), at(titles, i), at(dates, i), at(speakers, i)) for i, t in enumerate(texts)]
    return _segments(spark.createDataFrame(rows, "place string, text string, source_id string, title string, date string, speaker string"), min_words)


def _segments(rows: DataFrame, min_words: int) -> DataFrame:
    clean = rows.select(F.coalesce("source_id", F.concat(F.lit("src_"), "place")).alias("source_id"), "title", T.parsed_time(F.col("date")).alias("sent"), "speaker", T.clean_transcript(F.coalesce("text", F.lit(""))).alias("body"))
    return long_enough(clean, min_words)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of .txt, .eml and .msg files, by path."""
    files = spark.read.option("pathGlobFilter", "*.{txt,eml,msg}").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def read_archive(spark: SparkSession, path: str, sent_only: bool = True, most: int | None = None) -> DataFrame:
    """Messages of tar archives (gzip or not) of a maildir tree; columns as read_maildir. Members are parsed by all tasks.

    most keeps the newest messages of each owner only.
    """
    members = tar_members(spark, path).where("content is not null").select("path", "content")
    found = _owners(_parsed(members.repartition(spark.sparkContext.defaultParallelism)), sent_only)
    return found if most is None else capped(found, "owner", most, id_col="path")
