"""Game archives and puzzle tables."""

from __future__ import annotations

import codecs
import itertools
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import positions
from .packed import _files

#: A game begins at a line with this tag.
OPENING = "\n[Event "
#: Bytes of an archive's text that are read at a time, and games to a batch.
PIECE, ROWS = 1 << 20, 1024
#: Parentheses inside parentheses that are still removed.
NESTED = 8


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, place, text): one row per game of the .pgn, .txt and .zst files under ``path``.

    The separator is Spark's own line separator, so a plain file is read in splits. Compressed files are read
    by Spark's codecs, one task a file.
    """
    raw = spark.read.option("lineSep", OPENING).option("pathGlobFilter", "*.{pgn,txt,zst,gz}").option("recursiveFileLookup", True).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    text = F.regexp_replace("text", "^﻿", "")
    return rows.withColumn("text", F.when(text.startswith("[Event "), text).otherwise(F.concat(F.lit("[Event "), text))).where(F.length(F.trim("text")) > 8)


def _games(stream, separator: str = OPENING):
    """The pieces of a text stream that begin where a game does, one at a time; what comes before the first game is the
    first piece. Only the piece at hand is held."""
    decoder, rest, seen = codecs.getincrementaldecoder("utf-8")("replace"), "\n", 0
    while True:
        chunk = stream.read(PIECE)
        rest += decoder.decode(chunk, not chunk).replace("\r", "")
        begin = 0
        while (at := rest.find(separator, seen)) >= 0:
            yield rest[begin:at]
            begin = seen = at + 1
        rest = rest[begin:]
        seen = max(0, len(rest) - len(separator))
        if not chunk:
            yield rest
            return


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from .zip files, each of which must hold one .pgn file. An archive is a task of its own, which walks
    it as a stream: neither the archive nor what it holds is in memory or in a row whole."""

    def unzip(frames):
        for pdf in frames:
            for file in pdf["path"]:
                system, at = _files(file)
                with system.open_input_file(at) as source, zipfile.ZipFile(source) as z:
                    members = [n for n in z.namelist() if n.lower().endswith(".pgn")]
                    if len(members) != 1:
                        raise ValueError(f"{file} must hold one PGN file, not {members}")
                    with z.open(members[0]) as stream:
                        pieces = enumerate(_games(stream))
                        while batch := list(itertools.islice(pieces, ROWS)):
                            yield pd.DataFrame({"file": file, "at": 0, "place": [k for k, _ in batch], "text": [t for _, t in batch]})

    # the content is not asked for, so Spark lists the files and reads none
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    return paths.mapInPandas(unzip, "file string, at long, place long, text string").where(F.length(F.trim("text")) > 0)


def split_games(df: DataFrame, file: str, whole: str) -> DataFrame:
    """Rows of whole archives cut to games."""
    games = F.split(F.regexp_replace(F.concat(F.lit("\n"), F.col(whole)), "\r", ""), r"\n(?=\[Event )")
    rows = df.select(F.col(file).alias("file"), F.lit(0).cast("long").alias("at"), F.posexplode(games).alias("place", "text"))
    return rows.withColumn("place", F.col("place").cast("long")).where(F.length(F.trim("text")) > 0)


def parse_games(raw: DataFrame) -> DataFrame:
    """(game, headers, san, refused): games numbered from 0 over all files in their order, tags as a map, moves
    without comments, variations, annotations, numbers and results. ``refused`` names why a game is no input:
    variant or setup."""
    numbered = positions(raw, ["file", "at", "place"], "game")
    tag = r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'
    body = F.regexp_replace(F.regexp_replace("text", r"\r", ""), r'(?m)^\s*\[\w+\s+"(?:[^"\\]|\\.)*"\]\s*$', "")
    body = F.regexp_replace(F.regexp_replace(body, r"\{[^}]*\}", " "), r";[^\n]*", " ")
    for _ in range(NESTED):
        body = F.regexp_replace(body, r"\([^()]*\)", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"\$\d+|\d+\.+|[!?]+", " "), r"(?<!\S)(?:1-0|0-1|1/2-1/2|\*)(?!\S)", " ")
    entries = F.zip_with(F.regexp_extract_all("text", F.lit(tag), 1), F.regexp_extract_all("text", F.lit(tag), 2), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    # of a repeated tag the last one counts
    headers = F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"])))
    out = numbered.select("game", headers.alias("headers"), F.filter(F.split(body, r"\s+"), lambda x: x != "").alias("san"))
    variant = F.lower(F.coalesce(F.try_element_at("headers", F.lit("Variant")), F.lit("standard"))) != "standard"
    setup = F.map_contains_key("headers", "FEN") | F.map_contains_key("headers", "SetUp")
    return out.withColumn("refused", F.when(variant, "variant").when(setup, "setup"))


PUZZLE = "PuzzleId string, GameId string, FEN string, Moves string, Rating long, RatingDeviation long, Popularity long, NbPlays long, Themes array<string>, OpeningTags array<string>"


def read_puzzles(spark: SparkSession, path: str) -> DataFrame:
    """Puzzle rows with their file and place, in the order of file names."""
    raw = spark.read.option("recursiveFileLookup", True).parquet(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files under ``path``, by their names; empty files have no rows in Spark's reader, so
    ``digest_problems`` calls them missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, rule) of files that are missing, not expected, or not what they should be; expected: file, sha256."""
    met = found.select("file", F.col("sha256").alias("_own")).join(expected.select("file", "sha256"), "file", "full_outer")
    rule = F.when(F.col("_own").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.lower("sha256") != F.col("_own"), "changed")
    return met.select(F.col("file").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")


def first_games(games: DataFrame, most: int) -> DataFrame:
    """The first ``most`` games in the order of files and places; a top-k of each task, no sort of all."""
    return games.orderBy("file", "at", "place").limit(most)
