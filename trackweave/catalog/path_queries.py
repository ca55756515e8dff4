"""Paths, names, sample arrays and playlist output."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.catalog.cache_queries import scratch
from trackweave.catalog.inputs import TRACKS, Query, table, tracks
from trackweave.catalog.rule_queries import PLACED
from trackweave.functions import paths as P
from trackweave.functions import signal as S
from trackweave.operators import grouping as G
from trackweave.operators.chunks import split_samples
from trackweave.operators.clustering import distribution_check
from trackweave.operators.counters import store_playlists
from trackweave.operators.extraction import measures_from_chunks, measures_from_samples
from trackweave.plans.output import all_tracks as place_all
from trackweave.plans.output import run_counts as count_run
from trackweave.plans.output import save_playlists
from trackweave.session import settle, store
from trackweave.sources.m3u import read_m3u

# Detours that lead back to the same file; the same text runs in both engines.
DETOUR = (
    "CASE WHEN status = 'F' THEN replace(file_path, '/t', '//t') "
    "WHEN status = 'O' THEN replace(file_path, '/t', '/./x/../t') ELSE file_path || '/' END"
)


def normalise_path(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("crooked", F.expr(DETOUR))
    return t.select("ingest_seq", P.normalise_path(F.col("crooked")).alias("path"))


def normalise_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.normalise_path(F.col("url")).alias("path"))


def host_path(spark, sf_dir):
    """Files below the root, beside it with a longer name, and elsewhere."""
    path = F.expr(
        "CASE WHEN status = 'F' THEN file_path WHEN status = 'O' THEN replace(file_path, '/music/', '/music2//') "
        "ELSE replace(file_path, '/music/', '/other/') END"
    )
    return tracks(spark, sf_dir).select(
        "ingest_seq",
        P.host_path(path, "/music/", "/srv/media/").alias("host"),
        P.host_path(path, "/music/", "/srv/media/", strict_prefix=True).alias("strict"),
        P.host_path(path, "", "/srv/media").alias("unset"),
    )


HOST_SQL = f"""{TRACKS}
SELECT ingest_seq,
  CASE WHEN status = 'F' THEN replace(file_path, '/music/', '/srv/media/')
    WHEN status = 'O' THEN replace(file_path, '/music/', '/srv/media/../music2/')
    ELSE replace(file_path, '/music/', '/other/') END AS host,
  CASE WHEN status = 'F' THEN replace(file_path, '/music/', '/srv/media/')
    WHEN status = 'O' THEN replace(file_path, '/music/', '/music2/')
    ELSE replace(file_path, '/music/', '/other/') END AS strict,
  CASE WHEN status = 'F' THEN file_path WHEN status = 'O' THEN replace(file_path, '/music/', '/music2//')
    ELSE replace(file_path, '/music/', '/other/') END AS unset
FROM tracks"""


def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.basename(F.col("url")).alias("base"))


def audio_files(spark, sf_dir):
    """Extension test over page addresses and track paths in changing case."""
    path = F.expr("CASE WHEN status = 'F' THEN upper(file_path) WHEN status = 'O' THEN file_path || 'x' ELSE file_path END")
    return tracks(spark, sf_dir).withColumn("path", path).where(P.is_audio(F.col("path"))).select("ingest_seq", "path")


def sanitise_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.sanitise_name(F.col("text")).alias("name"))


def _measured(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("m", S.measures(F.col("embedding")))


def array_rms(spark, sf_dir):
    return _measured(spark, sf_dir).select("vec_id", F.round("m.rms", 6).alias("rms"))


def array_zcr(spark, sf_dir):
    return _measured(spark, sf_dir).select("vec_id", F.round("m.zcr", 6).alias("zcr"))


def array_centroid(spark, sf_dir):
    return _measured(spark, sf_dir).select("vec_id", F.round(S.centroid_hz(F.col("m.slope")), 4).alias("centroid"))


def array_nanmean(spark, sf_dir):
    """Means of the positive entries (others become NaN), of all, and the first entry."""
    marked = F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(F.lit(float("nan")).cast("float")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(S.nan_mean(marked), 6).alias("positive_mean"),
        F.round(S.plain_mean(F.col("embedding")), 6).alias("mean"),
        S.first_number(F.col("embedding")).alias("first"),
    )


def _buffers(spark, sf_dir):
    """Vectors as sample buffers; for every third label only their positive entries."""
    positive = F.filter("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") % 3 == 0, positive).otherwise(F.col("embedding")).alias("samples"),
        (F.col("label") * 30.0).alias("bpm"),
        F.col("label").alias("key"),
    )


def _shown(measured):
    return measured.select(
        "vec_id",
        F.round("duration", 9).alias("duration"),
        "bpm",
        F.round("loudness", 6).alias("loudness"),
        F.round("zcr", 6).alias("zcr"),
        F.round("centroid", 4).alias("centroid"),
        "danceability",
        "key",
        "error",
    )


def samples_measured(spark, sf_dir):
    """A buffer counts as long enough from 48 samples on and long enough for a key from 64 on."""
    return _shown(measures_from_samples(_buffers(spark, sf_dir), min_samples=48, min_key_samples=64))


def samples_chunked(spark, sf_dir):
    """The same measures out of chunks of ten samples."""
    buffers = _buffers(spark, sf_dir)
    chunks = split_samples(buffers, "vec_id", 10)
    tracks_only = buffers.drop("samples")
    return _shown(measures_from_chunks(tracks_only, chunks, "vec_id", min_samples=48, min_key_samples=64))


def _vectors(buffer: str) -> str:
    """Energy, sign changes and squared differences of each buffer."""
    return f"""
WITH b AS (SELECT vec_id, label, {buffer} AS x FROM embeddings),
v AS (
  SELECT vec_id, label, len(x) AS n,
    list_sum(list_transform(x, lambda a: CAST(a AS DOUBLE) * a)) AS energy,
    len(list_filter(range(2, len(x) + 1), lambda i: (x[i] > 0) <> (x[i - 1] > 0))) AS flips,
    coalesce(list_sum(list_transform(range(2, len(x) + 1),
      lambda i: (CAST(x[i] AS DOUBLE) - x[i - 1]) * (CAST(x[i] AS DOUBLE) - x[i - 1]))), 0e0) AS change
  FROM b)"""


VECTORS = _vectors("embedding")

SAMPLES_SQL = f"""{_vectors("CASE WHEN label % 3 = 0 THEN list_filter(embedding, lambda a: a > 0) ELSE embedding END")}
SELECT vec_id, round(n / 44100e0, 9) AS duration,
  CASE WHEN n < 48 THEN 0e0 ELSE label * 3e1 END AS bpm,
  CASE WHEN n < 48 THEN 0e0 ELSE round(sqrt(energy / n), 6) END AS loudness,
  CASE WHEN n < 48 THEN 0e0 ELSE round(flips / CAST(n AS DOUBLE), 6) END AS zcr,
  CASE WHEN n < 48 THEN 0e0 ELSE round(44100 / (2 * pi()) * sqrt(change) / sqrt(energy), 4) END AS centroid,
  0e0 AS danceability, CASE WHEN n < 64 THEN -1 ELSE label END AS key,
  CASE WHEN n = 0 THEN 'empty audio' END AS error FROM v"""


def _rule(spark, sf_dir):
    return G.rule_playlists(tracks(spark, sf_dir), unique_hashes=True)


def all_tracks(spark, sf_dir):
    """All playlists in one list, in playlist order."""
    result = _rule(spark, sf_dir)
    return place_all(result.tracks, result.summary).select("all_pos", "playlist", "file_path")


def run_counts(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return count_run(_rule(spark, sf_dir).summary, t.where("bpm IS NOT NULL"), t.where("bpm IS NULL"))


def counted_playlists(spark, sf_dir):
    """Counters taken while the playlists' tracks are written."""
    result = _rule(spark, sf_dir)
    return store_playlists(result.tracks, result.summary)[1]


def rule_distribution(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return distribution_check(_rule(spark, sf_dir).summary, G.usable(t))


def m3u_roundtrip(spark, sf_dir):
    """Playlist files as written in parts, read back with their line numbers: no task has a whole playlist."""
    target = scratch(spark)
    result = _rule(spark, sf_dir)
    save_playlists(store(result.tracks), settle(result.summary), target, "/music", "/srv/media", layout="parts", lines_per_part=PART)
    return read_m3u(spark, target).withColumn("line_number", F.col("line_number").cast("int"))


# Lines in a part of the playlists written by queries.
PART = 5_000

QUERIES = {
    "normalise_path": Query(
        normalise_path, f"{TRACKS} SELECT ingest_seq, file_path AS path FROM tracks"
    ),
    "normalise_url": Query(
        normalise_url,
        "SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', '') AS path FROM pages",
    ),
    "host_path": Query(host_path, HOST_SQL),
    "basename": Query(basename, "SELECT page_id, regexp_replace(url, '.*/', '') AS base FROM pages"),
    "audio_files": Query(
        audio_files,
        f"""{TRACKS} SELECT ingest_seq, CASE WHEN status = 'F' THEN upper(file_path) ELSE file_path END AS path
        FROM tracks WHERE status <> 'O'""",
    ),
    "sanitise_name": Query(
        sanitise_name,
        r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '_')
        AS name FROM documents""",
    ),
    "array_rms": Query(array_rms, f"{VECTORS} SELECT vec_id, round(sqrt(energy / n), 6) AS rms FROM v"),
    "array_zcr": Query(array_zcr, f"{VECTORS} SELECT vec_id, round(flips / CAST(n AS DOUBLE), 6) AS zcr FROM v"),
    "array_centroid": Query(
        array_centroid,
        f"{VECTORS} SELECT vec_id, round(44100 / (2 * pi()) * sqrt(change) / sqrt(energy), 4) AS centroid FROM v",
    ),
    "array_nanmean": Query(
        array_nanmean,
        """SELECT vec_id, coalesce(round(list_avg(list_transform(list_filter(embedding, lambda x: x > 0),
          lambda x: CAST(x AS DOUBLE))), 6), CAST('NaN' AS DOUBLE)) AS positive_mean,
          round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean,
          CAST(embedding[1] AS DOUBLE) AS first FROM embeddings""",
    ),
    "samples_measured": Query(samples_measured, SAMPLES_SQL),
    "samples_chunked": Query(samples_chunked, SAMPLES_SQL),
    "all_tracks": Query(
        all_tracks,
        f"""{PLACED} SELECT row_number() OVER (ORDER BY playlist_order, pos) AS all_pos, playlist, file_path
        FROM ordered""",
    ),
    "run_counts": Query(
        run_counts,
        f"""{PLACED} SELECT (SELECT count(*) FROM tracks WHERE bpm IS NOT NULL) AS ok_files,
          (SELECT count(DISTINCT file_path) FROM tracks WHERE bpm IS NULL) AS failed_files,
          count(DISTINCT playlist) AS saved_playlists, count(*) AS saved_tracks FROM ordered""",
    ),
    "counted_playlists": Query(
        counted_playlists,
        f"""{PLACED} SELECT count(DISTINCT playlist) AS saved_playlists, count(*) AS saved_tracks,
          count(*) FILTER (WHERE file_path IS NULL) AS unnamed, true AS balanced FROM ordered""",
    ),
    "rule_distribution": Query(
        rule_distribution,
        f"{PLACED} SELECT count(*) AS placed, count(*) AS tracks, true AS balanced FROM labelled",
    ),
    "m3u_roundtrip": Query(
        m3u_roundtrip,
        f"""{PLACED}, lines AS (SELECT playlist, playlist_order, pos, replace(file_path, '/music/', '/srv/media/') AS line FROM ordered)
        SELECT playlist, CAST(pos - 1 AS INT) AS line_number, line FROM lines
        UNION ALL SELECT 'All_Successful_Tracks', CAST(row_number() OVER (ORDER BY playlist_order, pos) - 1 AS INT), line
        FROM lines""",
    ),
}
