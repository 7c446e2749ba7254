"""Operator 5: not-modified revisits resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gleaner.llm.common import Scratch

#: Seconds of a time bucket: captures of one URL are ordered within a bucket by one task; beyond it, only one row a bucket.
BUCKET_SECONDS = 86_400
#: A bucket of more captures of one URL is cut in as many shorter ones as bring it to this number, down to a second.
BUCKET_ROWS = 100_000
#: Fixed value: header fields that a not-modified answer may bring up to date in what is stored (lower case).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Fixed value: query parameters that don't change what a URL names.
TRACKING = "ref|utm_[a-z]+|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """The key of a URL: without scheme, user, www., default port, fragment, tracking parameters and a slash at the end; host in
    lower case. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[.]", ""), ":(80|443)$", "")
    tail = F.regexp_replace(rest, "^[^/?]*", "")
    tail = F.regexp_replace(tail, f"([?&])({TRACKING})=[^&]*", "$1")
    tail = F.regexp_replace(F.regexp_replace(tail, "&+", "&"), "[?]&", "?")
    tail = F.regexp_replace(F.regexp_replace(tail, "[?&]+$", ""), "/+$", "")
    return F.concat(host, tail)


def _field(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _buckets(known: DataFrame, seconds: int, rows: int) -> DataFrame:
    """``known`` with bucket: the first second of the capture's time bucket."""
    start = lambda width: (F.floor(F.col("ts") / width) * width).cast("long")
    full = known.groupBy("canonical", start(F.lit(seconds)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    # Few as they are, they are written: a small table, which Spark can broadcast by its size instead of dealing all captures out for it.
    parts = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / rows))), F.lit(seconds)).cast("long")
    full = full.select(F.col("canonical").alias("url"), F.col("bucket").alias("from"), F.greatest(F.lit(seconds) / parts, F.lit(1)).cast("long").alias("width"))
    full = Scratch(known.sparkSession, "revisits").keep(full, "full")
    at = start(F.lit(seconds))
    joined = known.join(full, (F.col("canonical") == F.col("url")) & (at == F.col("from")), "left")
    inside = F.col("from") + F.floor((F.col("ts") - F.col("from")) / F.col("width")) * F.col("width")
    return joined.withColumn("bucket", F.coalesce(inside, at).cast("long")).drop("url", "from", "width")


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each revisit of ``records`` with the response that it stands for.

    ``records``: record_id long, url string, ts long (seconds), kind string (response or revisit), status int, headers
    map<string,string> (names in lower case), digest string (of the payload; may be missing). Returns record_id, canonical,
    ts, base_id (the latest full response, status 200, of the same canonical URL that is earlier by (ts, record_id)),
    verdict, headers and digest:

    - ``resolved``: the revisit's entity tag equals the base's by weak comparison; or one of them has none, and the dates of
      last modification are equal. headers are the base's, with the ``PERMITTED`` fields of the revisit put over them;
      digest is the base's: that of the payload that the revisit stands for. In all other cases digest is the revisit's own.
    - ``mismatch``: the first validator that both have differs; headers are the revisit's own.
    - ``unvalidated``: no validator that both have; headers are the revisit's own.
    - ``no_base``: no earlier full response, or a null url or ts; base_id is null.

    Responses are not returned. Repeated rows and ids: each revisit gives one row; of responses with equal (ts, record_id) one
    with the greatest headers (as text) is the base. Null headers count as none; empty tables give empty results; other
    columns are not read. Rows of one URL are looked through bucket by bucket of time, shorter where they are many, so that
    a URL with a large part of all captures is dealt out; from bucket to bucket goes the last response only.
    """
    empty = F.create_map().cast("map<string,string>")
    r = records.select(
        "record_id", "ts", canonical_url(F.col("url")).alias("canonical"), "kind", "status", F.coalesce("headers", empty).alias("headers"),
        (F.col("digest") if "digest" in records.columns else F.lit(None).cast("string")).alias("digest"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    r = r.where(full | (F.col("kind") == "revisit"))
    known = _buckets(r.where("canonical is not null and ts is not null"), bucket_seconds, bucket_rows)
    base = F.when(full, F.struct("record_id", "headers", "digest"))
    # Among rows of equal (ts, record_id) revisits come first: a response is never earlier than itself.
    order = ["ts", "record_id", F.when(full, 1).otherwise(0), F.to_json("headers")]
    before = W.Window.partitionBy("canonical", "bucket").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    seen = known.withColumn("base", F.last(base, ignorenulls=True).over(before)).where("kind = 'revisit'")
    ends = known.where(full).groupBy("canonical", "bucket").agg(
        F.max_by(F.struct("record_id", "headers", "digest"), F.struct("ts", "record_id", F.to_json("headers"))).alias("end")
    )
    asked = seen.where("base is null").select("canonical", "bucket").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    steps = ends.withColumn("own", F.lit(1)).unionByName(asked.withColumn("own", F.lit(0)))
    earlier = W.Window.partitionBy("canonical").orderBy("bucket").rangeBetween(W.Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).where("own = 0").select("canonical", "bucket", "carried")
    joined = seen.join(carried, ["canonical", "bucket"], "left")
    joined = joined.withColumn("base", F.coalesce("base", "carried")).select("record_id", "canonical", "ts", "headers", "digest", "base")
    lost = r.where("kind = 'revisit' and (canonical is null or ts is null)")
    joined = joined.unionByName(lost.select("record_id", "canonical", "ts", "headers", "digest", F.lit(None).cast(joined.schema["base"].dataType).alias("base")))

    mine, theirs = F.col("headers"), F.col("base.headers")
    tag, tag0 = _weak(_field(mine, "etag")), _weak(_field(theirs, "etag"))
    date, date0 = F.trim(_field(mine, "last-modified")), F.trim(_field(theirs, "last-modified"))
    verdict = (
        F.when(F.col("base").isNull(), "no_base")
        .when(tag.isNotNull() & tag0.isNotNull(), F.when(tag == tag0, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & date0.isNotNull(), F.when(date == date0, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    fresh = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    out = joined.withColumn("verdict", verdict)
    return out.select(
        "record_id", "canonical", "ts", F.col("base.record_id").alias("base_id"), "verdict",
        F.when(F.col("verdict") == "resolved", merged).otherwise(mine).alias("headers"),
        F.when(F.col("verdict") == "resolved", F.col("base.digest")).otherwise(F.col("digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages`` (page_id, url, html): every page is captured in full; every third comes again, changed, two
    days later; and each is revisited after one to four days, some with other validators or without an entity tag, some
    (every fifth page) although their first capture was an error.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    start = p * 60

    def record(kind: str, n: int, ts: Column, status: Column, headers: Column, when: Column, payload: Column) -> Column:
        fields = (p * 3 + n).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"), status.cast("int").alias("status"), headers.alias("headers")
        return F.when(when, F.struct(*fields, F.md5(payload).alias("digest")))

    text = lambda *kv: F.map_filter(F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv)), lambda k, v: v.isNotNull())
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    first = record("response", 0, start, F.when(p % 5 == 0, 404).otherwise(200), text("etag", tag, "last-modified", day(p % 30), "content-type", "text/html", "date", day(p % 7)), F.lit(True), F.col("html"))
    second = record("response", 1, start + 2 * 86_400, F.lit(200), text("etag", F.concat(F.lit('"2-'), F.md5("html"), F.lit('"')), "last-modified", day(p % 30 + 2), "content-type", "text/html"), p % 3 == 0, F.concat(F.lit("2-"), "html"))
    mark = F.when(p % 7 == 0, '"other"').when(p % 4 == 1, None).otherwise(F.concat(F.lit("W/"), tag))
    again = record("revisit", 2, start + (p % 4 + 1) * 86_400, F.lit(304), text("etag", mark, "last-modified", F.when(p % 8 != 1, day(p % 30)), "expires", day(p % 11), "content-type", "none"), F.lit(True), F.lit(""))
    rows = pages.select("url", F.explode(F.filter(F.array(first, second, again), lambda x: x.isNotNull())).alias("r"))
    return rows.select("url", "r.*")
