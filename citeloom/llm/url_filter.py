"""URL rules looked up in a sorted array of 64-bit digests.

The rule list becomes one file: sorted xxhash64 keys, offsets and the full rule strings with their verdicts. Spark ships
the file to each executor, workers memory-map it, probe every host-suffix and path-prefix of a batch with one vectorised
binary search, and confirm each hit against the stored string, so that digest collisions cannot give a verdict. The file
tells the longest host and path of a rule; longer suffixes and prefixes of a url cannot be rules and are not probed, so
the candidates of a url are bounded by the rules, whatever its length.

Defined results: a null url, or one without `://`, has an empty host and path and falls to the default verdict; equal
rows are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import read, shared_dir, slices

#: Rule -> verdict; a rule is a host followed by a path prefix.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST_END, PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def host_path(url: str | None) -> tuple[str, str]:
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = HOST_END.search(rest)
    if not m:
        return rest.translate(UPPER), ""
    path = rest[m.start() :]
    m2 = PATH_END.search(path)
    return rest[: m.start()].translate(UPPER), path[: m2.start()] if m2 else path


def digest(rule: bytes) -> int:
    return xxhash.xxh64_intdigest(rule)


def write_index(rules: dict[str, str], path: str) -> None:
    """n, longest host, longest path (code points); n sorted digests; n + 1 offsets; strings `verdict byte + rule`."""
    rows = sorted((digest(r.encode()), r.encode(), v) for r, v in rules.items())
    blobs = [(b"A" if v == "allow" else b"B") + r for _, r, v in rows]
    hosts, paths = [r.find("/") for r in rules], [len(r) - r.find("/") for r in rules]
    with open(path, "wb") as f:
        f.write(struct.pack("<QQQ", len(rows), max(hosts, default=0), max(paths, default=0)))
        f.write(np.array([d for d, _, _ in rows], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, blobs)]).astype("<u8").tobytes())
        f.write(b"".join(blobs))


class Index:
    """The memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, self.longest_host, self.longest_path = raw[:24].view("<u8").tolist()
        self.n = n
        self.digests = raw[24 : 24 + 8 * n].view("<u8")
        self.offsets = raw[24 + 8 * n : 32 + 16 * n].view("<u8")
        self.blob = raw[32 + 16 * n :]

    def row(self, k: int) -> bytes:
        return self.blob[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def find(self, keys: list[bytes]) -> dict[int, bool]:
        """Position of each key that is a rule -> whether the rule allows."""
        if not self.n or not keys:
            return {}
        digests = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        near = np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == digests)
        found = {}
        for i in near.tolist():
            k = int(at[i])
            while k < self.n and self.digests[k] == digests[i]:  # equal digests stand side by side
                row = self.row(k)
                if row[1:] == keys[i]:
                    found[i] = row[:1] == b"A"
                    break
                k += 1
        return found


def candidates(host: str, path: str, longest_host: int, longest_path: int) -> Iterator[bytes]:
    """Every rule that could fit: host suffixes at dots, path prefixes that end in a slash, none longer than a rule's."""
    if not host or not path:
        return
    ends = [m.end() for m in re.finditer("/", path[:longest_path])]
    at = len(host)
    while at >= 0 and len(host) - at <= longest_host + 1:
        at = host.rfind(".", 0, at) if at else -1
        suffix = host[at + 1 :]
        if len(suffix) <= longest_host:
            for e in ends:
                yield (suffix + path[:e]).encode("utf-8", "surrogatepass")


def judge(pages: DataFrame, rules: dict[str, str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict. Rules end in a slash; of those that fit, the longest string decides."""
    spark = pages.sparkSession
    if bad := [r for r in rules if "/" not in r or not r.endswith("/")]:
        raise ValueError(f"rules must be a host and a path that ends in a slash: {bad[:3]}")
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as folder:
        write_index(rules, os.path.join(folder, name))
        Path = spark._jvm.org.apache.hadoop.fs.Path
        target = Path(f"{shared_dir(spark)}/{name}")  # executors that start later fetch it from there, too
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(Path(f"file://{folder}/{name}"), target)
    spark.sparkContext.addFile(target.toString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for b in slices(batches, 4000, 1):
            parts = [host_path(u) for u in b.column(1).to_pylist()]
            keys: list[bytes] = []
            owner: list[int] = []
            for k, p in enumerate(parts):
                for c in candidates(*p, index.longest_host, index.longest_path):
                    keys.append(c)
                    owner.append(k)
            best: dict[int, tuple[int, bytes, bool]] = {}
            for i, allow in index.find(keys).items():
                text = keys[i].decode("utf-8", "surrogatepass")
                if owner[i] not in best or len(text) > best[owner[i]][0]:
                    best[owner[i]] = (len(text), text, allow)
            rule = [best[k][1] if k in best else None for k in range(len(parts))]
            verdict = [("allow" if best[k][2] else "block") if k in best else default for k in range(len(parts))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{url_col}` as url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES)
