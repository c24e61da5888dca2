"""File lists and what a run is sealed with: digests of sources and options, and its status."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 16


@dataclass
class Sources:
    files: list[str] = field(default_factory=list)
    include_dirs: list[str] = field(default_factory=list)
    defines: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def expand(text: str, env: Mapping[str, str]) -> str:
    """$NAME and ${NAME} replaced; names that are not set by nothing; a $ without a name stays."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: env.get(m[1] or m[2], ""), text)


def plus_parts(option: str) -> list[str]:
    """The arguments of +word+a+b."""
    return [p for p in option.split("+")[2:] if p]


def read_filelist(path: str, env: Mapping[str, str] | None = None, read: Callable[[str], str] | None = None, into: Sources | None = None, depth: int = 0) -> Sources:
    """The sources a list names, relative to its folder. Lists may name others (-f), up to MAX_DEPTH deep.
    // begins a comment where a word would, # ends the line; -v files are sources, -y is noted and skipped, as is
    what is not known."""
    if depth > MAX_DEPTH:
        raise ValueError(f"file lists are more than {MAX_DEPTH} deep at {path}")
    env, read, out = os.environ if env is None else env, read or (lambda p: open(p, encoding="utf-8").read()), into or Sources()
    here = PurePosixPath(path).parent
    words = [w for line in read(path).splitlines() for w in _words(line)]
    k = 0
    while k < len(words):
        word = expand(words[k], env)
        k += 1
        if word in ("-f", "-v", "-y"):
            if k == len(words):
                raise ValueError(f"{word} at the end of {path} names nothing")
            named = str(here / expand(words[k], env))
            k += 1
            if word == "-f":
                read_filelist(named, env, read, out, depth + 1)
            elif word == "-v":
                out.files.append(named)
            else:
                out.notes.append(f"-y {named} is ignored")
        elif word.startswith("+define+"):
            out.defines += plus_parts(word)
        elif word.startswith("+incdir+"):
            out.include_dirs += [str(here / p) for p in plus_parts(word)]
        elif word[:1] in ("+", "-"):
            out.notes.append(f"{word} is ignored")
        elif word:
            out.files.append(str(here / word))
    return out


def _words(line: str) -> list[str]:
    out = []
    for word in line.split():
        if word.startswith("//"):
            break
        head, mark, _ = word.partition("#")
        if head:
            out.append(head)
        if mark:
            break
    return out


def source_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest) of files, read and hashed by Spark."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("digest"))


def linked(files: DataFrame, sources: DataFrame) -> DataFrame:
    """The file table with src_file_id: the source of the same path, null where there is none."""
    at = sources.groupBy(F.col("path").alias("__path")).agg(F.min("id").alias("__src"))
    return files.drop("src_file_id").join(at, F.col("path") == F.col("__path"), "left").select("id", "path", F.col("__src").alias("src_file_id"))


def interned(texts: DataFrame, column: str) -> DataFrame:
    """(id, text) for the distinct texts of a column, with dense ids in their order; empty and null texts have none."""
    from wirespan.operators import stamp

    some = texts.select(F.col(column).alias("text")).where("text <> ''").distinct().withColumn("one", F.lit(1))
    return stamp.bases(some, ["text"], ["one"]).select((F.col("base_one") + 1).alias("id"), "text")


def config_digest(items: Iterable[tuple[str, str]]) -> str:
    """SHA-256 over tag:length:value lines; the length keeps one value from passing for two."""
    h = hashlib.sha256()
    for tag, value in items:
        raw = value.encode()
        h.update(f"{tag}:{len(raw)}:".encode() + raw + b"\n")
    return h.hexdigest()


def status(errors: int = 0, empty_procedures: int = 0, duplicate_paths: int = 0, truncated_calls: int = 0, fatal: bool = False, scopes: int = 1) -> str:
    """complete, partial or hierarchy_only. Unresolved instances do not count against a run."""
    if fatal or not scopes:
        return "hierarchy_only"
    return "partial" if errors or empty_procedures or duplicate_paths or truncated_calls else "complete"


def meta(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "key string, value string")


def merged_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by key, the new ones where both have them."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)
