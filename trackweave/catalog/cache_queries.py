"""Feature table upkeep, scans and coercions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.catalog.inputs import TRACKS, Query, table, tracks
from trackweave.functions import paths as P
from trackweave.functions import scalars as N
from trackweave.operators import cache as C
from trackweave.operators import extraction as E
from trackweave.schema import ADDED_COLUMN_DEFAULTS, evolve_features
from trackweave.session import use_checkpoint_dir
from trackweave.sources.bucketed import BucketedTable
from trackweave.sources.files import big_enough as list_big
from trackweave.sources.table import KeyedTable
from trackweave.streaming.ingest import fresh_rows, save_stream, upsert_stream

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cache_upsert_latest(spark, sf_dir):
    """Closed lines are the table, open lines the new batch, both with repeated keys."""
    lines = table(spark, sf_dir, "lineitem")
    newest = [F.desc(c) for c in LINE_ORDER]
    old = C.latest_per_key(lines.where("l_linestatus = 'F'"), LINE_KEY, newest)
    return C.upsert(old, lines.where("l_linestatus <> 'F'"), LINE_KEY, newest)


def _cached(spark, sf_dir):
    """Tracks as a feature table; modification times are days since 1970 in seconds."""
    days = F.date_diff(F.col("last_analyzed").cast("date"), F.lit("1970-01-01").cast("date")) + 60
    missing = ["loudness", "onset_rate", "zcr"]
    return (
        tracks(spark, sf_dir)
        .withColumns({c: F.lit(None).cast("double") for c in missing})
        .withColumn("last_modified", days * 86400.0)
    )


def _files(spark, sf_dir):
    """One file per order line: many files share the hash of their order."""
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", F.lit("/music/copies"), "l_partkey", "l_suppkey", "l_linenumber").alias("file_path"),
        F.col("l_orderkey").cast("string").alias("file_hash"),
        (days * 86400.0).alias("last_modified"),
    )


def cache_lookup_hits(spark, sf_dir):
    found = C.lookup(_files(spark, sf_dir), _cached(spark, sf_dir)).where("is_hit")
    return found.select(
        "file_hash", "file_path", "filename", "last_modified", "bpm", "centroid", "danceability", "key", "scale"
    )


def cache_lookup_misses(spark, sf_dir):
    found = C.lookup(_files(spark, sf_dir), _cached(spark, sf_dir)).where("NOT is_hit")
    return found.select("file_hash", "file_path", "last_modified")


FILES = f"""{TRACKS},
cached AS (
  SELECT *, CAST((date_diff('day', DATE '1970-01-01', CAST(last_analyzed AS DATE)) + 60) * 86400 AS DOUBLE) AS cached_at
  FROM tracks),
files AS (
  SELECT '/music/copies/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS file_path,
    CAST(l_orderkey AS VARCHAR) AS file_hash, CAST(l_linenumber AS VARCHAR) AS filename,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 86400 AS DOUBLE) AS last_modified
  FROM lineitem)"""


def _listing(spark, sf_dir):
    return tracks(spark, sf_dir).where("status <> 'P'")


def purge_missing(spark, sf_dir):
    return C.missing_rows(tracks(spark, sf_dir), _listing(spark, sf_dir)).select("file_path", "file_hash")


def purge_kept(spark, sf_dir):
    return C.present_rows(tracks(spark, sf_dir), _listing(spark, sf_dir)).select("file_path", "file_hash")


def _bucketed(spark, rows, key):
    kept = BucketedTable(spark, scratch(spark), key, 16)
    kept.write(rows)
    return kept


def bucketed_purge(spark, sf_dir):
    """The purge against a table in buckets of its paths."""
    lacking = _bucketed(spark, tracks(spark, sf_dir), "file_path").lacking(_listing(spark, sf_dir))
    return lacking.select("file_path", "file_hash")


def bucketed_lookup(spark, sf_dir):
    """The lookup against a table in buckets of its hashes."""
    files = _files(spark, sf_dir)
    cached = _bucketed(spark, _cached(spark, sf_dir), "file_hash").matching(files)
    found = C.lookup(files, cached).where("is_hit")
    return found.select("file_hash", "file_path", "filename", "last_modified", "bpm", "centroid", "key", "scale")


def failed_distinct(spark, sf_dir):
    """Purged paths together with those of files below the size limit."""
    small = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select("l_orderkey").distinct()
    t = tracks(spark, sf_dir)
    failed = t.join(small, t["ingest_seq"] == small["l_orderkey"], "left_semi")
    return C.failed_paths(C.missing_rows(t, _listing(spark, sf_dir)), failed)


def _playlists(spark, sf_dir):
    """One playlist per nation, all last updated with the turn of the century."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(
        F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("last_updated")
    )


def changed_since(spark, sf_dir):
    return C.changed_since(tracks(spark, sf_dir), _playlists(spark, sf_dir)).select("file_path", "file_hash")


def changed_since_null(spark, sf_dir):
    """No playlist yet: nothing counts as changed."""
    none = _playlists(spark, sf_dir).where("id < 0")
    return C.changed_since(tracks(spark, sf_dir), none).select("file_path", "file_hash")


def changed_since_null_all(spark, sf_dir):
    none = _playlists(spark, sf_dir).where("id < 0")
    return C.changed_since(tracks(spark, sf_dir), none, "all").select("file_path", "file_hash")


def _links(spark, sf_dir):
    """Every track linked to its owner's playlist, and every line to an unknown track."""
    own = tracks(spark, sf_dir).select((F.col("owner") % 30).alias("playlist_id"), "file_hash")
    stray = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 30).alias("playlist_id"), F.concat(F.lit("gone-"), "s_suppkey").alias("file_hash")
    )
    return own.unionByName(stray)


def unlink_changed(spark, sf_dir):
    changed = C.changed_since(tracks(spark, sf_dir), _playlists(spark, sf_dir))
    return C.unlink_changed(_links(spark, sf_dir), tracks(spark, sf_dir), changed)


def unlink_listed(spark, sf_dir):
    """Links without those of a given list of changed paths."""
    listed = tracks(spark, sf_dir).where("status = 'P'").select("file_path")
    return C.unlink_changed(_links(spark, sf_dir), tracks(spark, sf_dir), listed)


def stamp_playlists(spark, sf_dir):
    """Every playlist updated at the time of the newest order."""
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return C.stamp_updated(_playlists(spark, sf_dir), newest)


def fill_required(spark, sf_dir):
    return E.fill_required(tracks(spark, sf_dir)).select("ingest_seq", "bpm", "centroid", "duration", "danceability")


def clamp_confidence(spark, sf_dir):
    """Confidences between -0.5 and 1.5, some missing or NaN."""
    raw = F.when(F.col("key").isNull(), F.lit(float("nan"))).otherwise(F.col("beat_confidence") * 2 - F.lit(0.5))
    raw = F.when(F.col("bpm").isNotNull(), raw)
    return tracks(spark, sf_dir).select("ingest_seq", F.round(N.beat_confidence(raw), 6).alias("confidence"))


def cached_and_fresh(spark, sf_dir):
    """Cached measures of the hits together with defaults for the misses, as one list."""
    found = C.lookup(_files(spark, sf_dir), _cached(spark, sf_dir))
    # One pass over one lookup: a hit keeps its measures, whatever they are.
    measures = {c: F.when(F.col("is_hit"), F.col(c)).otherwise(F.lit(E.MEASURE_DEFAULTS[c])) for c in ("bpm", "key")}
    return found.withColumns(measures).select("file_path", "file_hash", "is_hit", "bpm", "key")


def big_enough(spark, sf_dir):
    """Order lines as files of some hundred bytes per unit: those large enough to be audio."""
    sized = table(spark, sf_dir, "lineitem").withColumn("length", (F.col("l_quantity") * 100).cast("long"))
    return list_big(sized).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "length")


def orphan_links(spark, sf_dir):
    return C.orphan_links(_links(spark, sf_dir), _playlists(spark, sf_dir), tracks(spark, sf_dir))


PLAYLISTS = f"""{TRACKS},
playlists AS (
  SELECT c_nationkey AS id, TIMESTAMP '2000-01-01 00:00:00' AS last_updated FROM customer GROUP BY c_nationkey),
links AS (
  SELECT owner % 30 AS playlist_id, file_hash FROM tracks
  UNION ALL SELECT s_suppkey % 30, 'gone-' || s_suppkey FROM supplier),
changed AS (
  SELECT * FROM tracks WHERE last_analyzed > (SELECT max(last_updated) FROM playlists))"""


def schema_evolve(spark, sf_dir):
    """An older table without three of the columns; NULL keys already stored stay NULL."""
    old = tracks(spark, sf_dir).select("file_hash", "file_path", "bpm", "key", "danceability")
    return evolve_features(old).select("file_hash", "bpm", *ADDED_COLUMN_DEFAULTS)


def latest_per_path(spark, sf_dir):
    newest = tracks(spark, sf_dir).withColumn("last_modified", F.col("duration"))
    return C.latest_per_path(newest).select("file_path", "file_hash", "last_modified")


def scan_features(spark, sf_dir):
    """All measures of the table, without hash and times."""
    more = {"loudness": F.col("bpm") / 2, "onset_rate": F.col("danceability") * 4, "zcr": F.col("duration") / 8}
    return C.scan_features(_cached(spark, sf_dir).withColumns(more))


def coerce(spark, sf_dir):
    """Numbers out of text that often is none."""
    text = F.expr(
        "CASE WHEN event_type = 'click' THEN CAST(value AS STRING) WHEN event_type = 'view' THEN props "
        "WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS STRING) END"
    )
    return table(spark, sf_dir, "events").withColumn("text", text).select(
        "event_id",
        N.as_float(F.col("text")).alias("as_float"),
        N.as_int(F.col("text")).alias("as_int"),
        N.as_int(F.col("value")).alias("value_int"),
    )


COERCE_SQL = """
WITH t AS (
  SELECT event_id, value, CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) WHEN event_type = 'view' THEN props
    WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS text FROM events)
SELECT event_id, coalesce(try_cast(text AS DOUBLE), 0e0) AS as_float,
  CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN CAST(text AS INT) ELSE 0 END AS as_int,
  CAST(trunc(value) AS INT) AS value_int FROM t"""

KEY_TEXT = "split_part('C,C#,D,D#,E,F,F#,G,G#,A,A#,B,H,c', ',', CAST(ingest_seq % 14 + 1 AS INT))"


def key_index(spark, sf_dir):
    named = tracks(spark, sf_dir).withColumn("name", F.expr(KEY_TEXT))
    mode = F.expr("CASE WHEN status = 'F' THEN 'major' WHEN status = 'O' THEN 'minor' END")
    return named.select(
        "ingest_seq", N.key_index(F.col("name")).alias("key_index"), N.scale_index(mode).alias("scale_index")
    )


KEY_INDEX_SQL = f"""{TRACKS}
SELECT ingest_seq, CASE WHEN ingest_seq % 14 < 12 THEN CAST(ingest_seq % 14 AS INT) ELSE -1 END AS key_index,
  CASE WHEN status = 'F' THEN 1 ELSE 0 END AS scale_index FROM tracks"""


def file_key(spark, sf_dir):
    """Content keys; files without a readable time get the md5 of their path."""
    micros = F.expr("CASE WHEN key IS NULL THEN NULL ELSE ingest_seq * 1000003 END")
    return tracks(spark, sf_dir).select(
        "ingest_seq", P.file_key(F.col("file_path"), F.col("owner"), micros).alias("file_key")
    )


FILE_KEY_SQL = f"""{TRACKS}
SELECT ingest_seq, CASE WHEN key IS NULL THEN md5(file_path)
  ELSE regexp_replace(file_path, '.*/', '') || '_' || owner || '_' || (ingest_seq * 1000003) END AS file_key
FROM tracks"""


LATEST_EVENT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def stream_upsert(spark, sf_dir):
    """Events as a stream of several files, out of order; the newest event of each user stays.

    Files are dealt by a hash of the event, so most batches hold rows older than what the table has.
    """
    root = scratch(spark)
    events = table(spark, sf_dir, "events").select(*LATEST_EVENT.names)
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{root}/source")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    latest = KeyedTable(spark, f"{root}/table", LATEST_EVENT, ["user_id"], ["ts", "event_id"], buckets=4)
    upsert_stream(stream, latest, f"{root}/progress").awaitTermination()
    return latest.read()


# Events as files of a stream: which file an event comes in, and those that come twice; the same text runs in both engines.
ARRIVALS = """
  SELECT event_id, ts, user_id, value, base + CASE event_id % 17 WHEN 3 THEN 1 WHEN 5 THEN 3 ELSE 0 END AS arrival
  FROM (SELECT *, CAST((day(ts) - 1) // 4 AS INT) AS base FROM {events})
  UNION ALL SELECT event_id, ts, user_id, value, CAST((day(ts) - 1) // 4 AS INT) + CASE event_id % 4 WHEN 0 THEN 4 ELSE 1 END
  FROM {events} WHERE event_id % 10 = 0"""
# Days that an event may be late.
LATE_DAYS = 6


def stream_late(spark, sf_dir):
    """Events once each, without those that come too late: late, repeated and too late rows over a dozen batches."""
    root = scratch(spark)
    text = ARRIVALS.replace("//", "DIV")
    rows = spark.sql(text, events=table(spark, sf_dir, "events")).withColumn("time", F.col("ts").cast("timestamp"))
    rows.write.partitionBy("arrival").parquet(f"{root}/rows")
    for (number,) in rows.select("arrival").distinct().orderBy("arrival").collect():
        # One file after the other: files are taken in the order of their times.
        part = spark.read.parquet(f"{root}/rows").where(F.col("arrival") == number).drop("arrival")
        part.coalesce(1).write.mode("append").parquet(f"{root}/source")
    schema = spark.read.parquet(f"{root}/source").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    fresh = fresh_rows(stream, ["event_id"], "time", f"{LATE_DAYS} days")
    save_stream(fresh.drop("time"), f"{root}/out", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "ts", "user_id", "value")


LATE_SQL = f"""WITH arrivals AS ({ARRIVALS.replace("{events}", "events")}),
newest AS (SELECT arrival, max(ts) AS ts FROM arrivals GROUP BY arrival),
marks AS (SELECT a.arrival, max(n.ts) - INTERVAL {LATE_DAYS} DAY AS mark
  FROM (SELECT DISTINCT arrival FROM arrivals) a LEFT JOIN newest n ON n.arrival < a.arrival - 1 GROUP BY a.arrival)
SELECT DISTINCT a.event_id, a.ts, a.user_id, a.value FROM arrivals a JOIN marks m ON a.arrival = m.arrival
WHERE m.mark IS NULL OR a.ts > m.mark"""


LINE = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("version", T.IntegerType()),
    ]
)


def table_versions(spark, sf_dir):
    """A keyed table after upsert, deletion and upsert: lines come, returned ones go, later ones come back."""
    rows = table(spark, sf_dir, "lineitem").groupBy(*LINE_KEY).agg(
        F.max("l_extendedprice").cast("double").alias("price"), F.max("l_returnflag").alias("flag")
    )
    lines = KeyedTable(spark, f"{scratch(spark)}/lines", LINE, LINE_KEY, ["version"], buckets=4)
    one = rows.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "price", "flag")
    lines.append(one.withColumn("version", F.lit(1)).drop("flag"))
    lines.forget(one.where("flag = 'R'"))
    again = one.where("l_orderkey % 3 = 0").withColumns({"version": F.lit(2), "price": F.col("price") * 2})
    lines.append(again.drop("flag"))
    return lines.read()


QUERIES = {
    "cache_upsert_latest": Query(
        cache_upsert_latest,
        f"""SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_linestatus = 'F', {", ".join(c + " DESC" for c in LINE_ORDER)}) AS rn FROM lineitem)
        WHERE rn = 1""",
    ),
    "cache_lookup_hits": Query(
        cache_lookup_hits,
        f"""{FILES} SELECT f.file_hash, f.file_path, f.filename, f.last_modified, c.bpm, c.centroid, c.danceability,
          c.key, c.scale FROM files f JOIN cached c ON f.file_hash = c.file_hash AND c.cached_at >= f.last_modified""",
    ),
    "cache_lookup_misses": Query(
        cache_lookup_misses,
        f"""{FILES} SELECT f.file_hash, f.file_path, f.last_modified FROM files f WHERE NOT EXISTS (
          SELECT 1 FROM cached c WHERE f.file_hash = c.file_hash AND c.cached_at >= f.last_modified)""",
    ),
    "purge_missing": Query(
        purge_missing,
        f"""{TRACKS} SELECT file_path, file_hash FROM tracks
        WHERE file_path NOT IN (SELECT file_path FROM tracks WHERE status <> 'P')""",
    ),
    "bucketed_purge": Query(
        bucketed_purge,
        f"""{TRACKS} SELECT file_path, file_hash FROM tracks
        WHERE file_path NOT IN (SELECT file_path FROM tracks WHERE status <> 'P')""",
    ),
    "bucketed_lookup": Query(
        bucketed_lookup,
        f"""{FILES} SELECT f.file_hash, f.file_path, f.filename, f.last_modified, c.bpm, c.centroid, c.key, c.scale
        FROM files f JOIN cached c ON f.file_hash = c.file_hash AND c.cached_at >= f.last_modified""",
    ),
    "purge_kept": Query(
        purge_kept,
        f"""{TRACKS} SELECT file_path, file_hash FROM tracks
        WHERE file_path IN (SELECT file_path FROM tracks WHERE status <> 'P')""",
    ),
    "failed_distinct": Query(
        failed_distinct,
        f"""{TRACKS} SELECT DISTINCT file_path FROM tracks
        WHERE file_path NOT IN (SELECT file_path FROM tracks WHERE status <> 'P')
          OR ingest_seq IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 5)""",
    ),
    "changed_since": Query(changed_since, f"{PLAYLISTS} SELECT file_path, file_hash FROM changed"),
    "changed_since_null": Query(
        changed_since_null,
        f"""{PLAYLISTS} SELECT file_path, file_hash FROM tracks
        WHERE last_analyzed > (SELECT max(last_updated) FROM playlists WHERE id < 0)""",
    ),
    "changed_since_null_all": Query(
        changed_since_null_all, f"{TRACKS} SELECT file_path, file_hash FROM tracks"
    ),
    "unlink_changed": Query(
        unlink_changed,
        f"""{PLAYLISTS} SELECT playlist_id, file_hash FROM links WHERE file_hash NOT IN (
          SELECT file_hash FROM tracks WHERE file_path IN (SELECT file_path FROM changed))""",
    ),
    "unlink_listed": Query(
        unlink_listed,
        f"""{PLAYLISTS} SELECT playlist_id, file_hash FROM links WHERE file_hash NOT IN (
          SELECT file_hash FROM tracks WHERE file_path IN (SELECT file_path FROM tracks WHERE status = 'P'))""",
    ),
    "stamp_playlists": Query(
        stamp_playlists,
        f"""{PLAYLISTS} SELECT CAST(id AS BIGINT) AS id, (SELECT max(o_orderdate) FROM orders) AS last_updated
        FROM playlists""",
    ),
    "fill_required": Query(
        fill_required,
        f"""{TRACKS} SELECT ingest_seq, coalesce(bpm, 0e0) AS bpm, coalesce(centroid, 0e0) AS centroid,
          coalesce(duration, 0e0) AS duration, danceability FROM tracks""",
    ),
    "clamp_confidence": Query(
        clamp_confidence,
        f"""{TRACKS} SELECT ingest_seq, CASE WHEN bpm IS NULL THEN NULL WHEN key IS NULL THEN 1e0
          ELSE round(greatest(0e0, least(1e0, beat_confidence * 2 - 5e-1)), 6) END AS confidence FROM tracks""",
    ),
    "cached_and_fresh": Query(
        cached_and_fresh,
        f"""{FILES} SELECT f.file_path, f.file_hash, c.file_hash IS NOT NULL AS is_hit,
          CASE WHEN c.file_hash IS NULL THEN 0e0 ELSE c.bpm END AS bpm,
          CASE WHEN c.file_hash IS NULL THEN -1 ELSE c.key END AS key
        FROM files f LEFT JOIN cached c ON f.file_hash = c.file_hash AND c.cached_at >= f.last_modified""",
    ),
    "big_enough": Query(
        big_enough,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * 100 AS BIGINT) AS length
        FROM lineitem WHERE l_quantity * 100 >= 1024""",
    ),
    "orphan_links": Query(
        orphan_links,
        f"""{PLAYLISTS} SELECT playlist_id, file_hash, 'playlist' AS broken FROM links
          WHERE playlist_id NOT IN (SELECT id FROM playlists)
        UNION ALL SELECT playlist_id, file_hash, 'track' FROM links
          WHERE file_hash NOT IN (SELECT file_hash FROM tracks)""",
    ),
    "schema_evolve": Query(
        schema_evolve,
        f"""{TRACKS} SELECT file_hash, bpm, 0e0 AS loudness, danceability, key, CAST(0 AS INT) AS scale,
          0e0 AS onset_rate, 0e0 AS zcr FROM tracks""",
    ),
    "latest_per_path": Query(
        latest_per_path,
        f"""{TRACKS} SELECT file_path, file_hash, duration AS last_modified FROM (
          SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY duration DESC, ingest_seq DESC) AS rn FROM tracks)
        WHERE rn = 1""",
    ),
    "scan_features": Query(
        scan_features,
        f"""{TRACKS} SELECT file_path, duration, bpm, beat_confidence, centroid, bpm / 2 AS loudness, danceability, key,
          scale, danceability * 4 AS onset_rate, duration / 8 AS zcr FROM tracks""",
    ),
    "coerce": Query(coerce, COERCE_SQL),
    "key_index": Query(key_index, KEY_INDEX_SQL),
    "file_key": Query(file_key, FILE_KEY_SQL),
    "stream_late": Query(stream_late, LATE_SQL),
    "stream_upsert": Query(
        stream_upsert,
        """SELECT user_id, ts, event_id, event_type, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1""",
    ),
    "table_versions": Query(
        table_versions,
        """WITH rows AS (
          SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
            CAST(max(l_extendedprice) AS DOUBLE) AS price, max(l_returnflag) AS flag
          FROM lineitem GROUP BY l_orderkey, l_linenumber)
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN price * 2 ELSE price END AS price,
          CAST(CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS version
        FROM rows WHERE flag <> 'R' OR l_orderkey % 3 = 0""",
    ),
}
