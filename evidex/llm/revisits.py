"""Not-modified captures of the snapshot log, resolved to the full response they stand for.

A snapshot with status 304 has no body. It is joined as of its time to the latest earlier snapshot of the same canonical
URL with status 200; the join is accepted if their validators agree, and then takes that body, and its headers with those
that a 304 may update laid over them (RFC 9111, section 3.2).

The as-of step is an ordered scan over (canonical URL, day) slices of narrow rows, so a URL with a third of all
snapshots is many slices; bodies move once, in the join by snapshot id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.ordered import ordered_scan, time_slice

# --- fixed values: headers that a 304 response does not replace (RFC 9111, 3.2), and tracking parameters ---
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate",
              "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme and default port dropped, host in lower case, no fragment, no tracking parameters, no closing slash."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def same_validators(etag: Column, modified: Column, old_etag: Column, old_modified: Column) -> Column:
    """Whether a 304 can be about a response: by entity tag (weak comparison) if it has one, else by date, else yes."""
    weak = lambda tag: F.regexp_replace(F.trim(tag), r"^[Ww]/", "")
    return F.coalesce(F.when(etag.isNotNull(), F.coalesce(weak(etag) == weak(old_etag), F.lit(False)))
                      .when(modified.isNotNull(), F.coalesce(modified == old_modified, F.lit(False))), F.lit(True))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, names in lower case, with the permitted ones of the 304 laid over them."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    allowed = F.map_filter(lower(fresh), lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    kept = F.map_filter(lower(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, canonical_url, outcome, source_id, body, headers`` of every snapshot with status 304.

    ``snapshots`` has ``snapshot_id`` (unique), ``url``, ``fetched_at``, ``http_status``, ``etag``, ``last_modified``, ``headers``
    (map of strings) and ``body``. ``outcome`` is ``resolved``, ``changed`` (the latest earlier full response has other
    validators; ``source_id`` names it, body and headers are null) or ``missing`` (there is none). Of full responses at one
    time the one with the greatest id counts; one at the very time of the 304 is not earlier. A null url or time matches nothing
    (``missing``); a 304 with a null id is answered like others, a 200 with one takes no part. Repeated rows of a 304 are answered each; of 200s with
    one id and time the one with the least body counts, once. Other columns are not looked at.
    """
    log = snapshots.select("snapshot_id", "http_status", "etag", "last_modified", F.col("fetched_at").cast("timestamp").alias("fetched_at"), canonical_url(F.col("url")).alias("canonical_url"))
    # A full response without an id cannot be named or found again.
    log = log.filter("http_status = 304 or http_status = 200 and snapshot_id is not null")
    micros = F.unix_micros("fetched_at")
    known = log.filter("canonical_url is not null and fetched_at is not null").withColumns({
        "at": micros, "full": (F.col("http_status") == 200).cast("int"),
        "head": F.when(F.col("http_status") == 200, F.struct("snapshot_id", "etag", "last_modified"))})
    found = ordered_scan(known, ["canonical_url"], ["at", "full", "snapshot_id"], time_slice("at"), {"source": ("running_last", "head")})
    revisits = found.filter("full = 0").select("snapshot_id", "canonical_url", "etag", "last_modified", "source")
    blank = log.filter("http_status = 304 and (canonical_url is null or fetched_at is null)")
    revisits = revisits.unionByName(blank.select("snapshot_id", "canonical_url", "etag", "last_modified", F.lit(None).cast(found.schema["source"].dataType).alias("source")))
    good = same_validators(F.col("etag"), F.col("last_modified"), F.col("source.etag"), F.col("source.last_modified"))
    judged = revisits.withColumn("outcome", F.when(F.col("source").isNull(), "missing").when(good, "resolved").otherwise("changed")).withColumn("source_id", F.col("source.snapshot_id"))
    fresh = snapshots.filter("http_status = 304").groupBy("snapshot_id").agg(F.max(F.to_json("headers")).alias("fresh"))
    full = snapshots.filter("http_status = 200 and snapshot_id is not null").select(F.col("snapshot_id").alias("body_of"), "body", F.col("headers").alias("kept"))
    # Bodies are aggregated only where a response was logged twice: a plain join may split an id that many revisits name.
    if not full.groupBy("body_of").count().filter("count > 1").isEmpty():
        least = F.min(F.struct("body", F.to_json("kept").alias("kept"))).alias("r")
        full = full.groupBy("body_of").agg(least).select("body_of", "r.body", F.from_json("r.kept", "map<string,string>").alias("kept"))
    judged = judged.withColumn("body_of", F.when(F.col("outcome") == "resolved", F.col("source_id")))
    out = judged.join(fresh, "snapshot_id", "left").join(full, "body_of", "left")
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("kept"), F.from_json("fresh", "map<string,string>")))
    return out.select("snapshot_id", "canonical_url", "outcome", "source_id", "body", headers.alias("headers"))
