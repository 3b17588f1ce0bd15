"""URL filters: a sorted array of rule digests, probed by binary search and confirmed against the stored rules."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import table

#: (verdict, host, path): fixed values of the query's rule set.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def write_rules(rules: list[tuple[str, str, str]], folder: str) -> str:
    """One file: the number of rules, sorted 64-bit digests, offsets, verdicts, then the rules' strings."""
    made = sorted((xxhash.xxh64_intdigest(host + path), (host + path).encode(), verdict) for verdict, host, path in rules)
    texts = [t for _, t, _ in made]
    path = os.path.join(folder, f"rules-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as f:
        f.write(np.array([len(made)], "<u8").tobytes())
        f.write(np.array([d for d, _, _ in made], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes())
        f.write(np.array([v == "block" for _, _, v in made], np.uint8).tobytes())
        f.write(b"".join(texts))
    return path


class Rules:
    """The file of write_rules, memory-mapped: only the pages that a probe touches are read."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.blocks = raw[16 + 16 * n : 16 + 17 * n]
        self.texts = raw[16 + 17 * n :]

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key in the array, or -1. Digests that collide stand side by side; all are compared."""
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests):
            return out
        first = np.searchsorted(self.digests, wanted, "left")
        last = np.searchsorted(self.digests, wanted, "right")
        for i in np.flatnonzero(last > first).tolist():
            key = keys[i].encode()
            for j in range(first[i], last[i]):
                if self.texts[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == key:
                    out[i] = j
        return out

    def text(self, place: int) -> str:
        return self.texts[int(self.offsets[place]) : int(self.offsets[place + 1])].tobytes().decode()


@lru_cache(4)
def _opened(name: str) -> Rules:
    return Rules(SparkFiles.get(name))


def _judge(batches: Iterator[pd.DataFrame], name: str, longest: int, lengths: list[int], default: str) -> Iterator[pd.DataFrame]:
    """Probes of one url: each tail of its host that is no longer than the ``longest`` rule's host, with each prefix of
    its path as long as some rule's path. A long host has no more probes than a short one."""
    for pdf in batches:
        rules, keys, owner = _opened(name), [], []
        for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
            at = 0 if len(host) <= longest else host.find(".", len(host) - longest - 1) + 1
            while host and len(host) - at <= longest:
                tail = host[at:]
                probes = [tail + path[:n] for n in lengths if n <= len(path)]
                keys += probes
                owner += [i] * len(probes)
                at = host.find(".", at) + 1
                if not at:
                    break
        place = rules.find(keys)
        hit = np.flatnonzero(place >= 0)
        found = pd.DataFrame({"i": np.array(owner, int)[hit], "place": place[hit], "n": [len(keys[j]) for j in hit]})
        best = found.sort_values(["i", "n"]).drop_duplicates("i", keep="last")
        rule, verdict = np.full(len(pdf), None, object), np.full(len(pdf), default, object)
        rule[best["i"]] = [rules.text(p) for p in best["place"]]
        verdict[best["i"]] = np.where(rules.blocks[best["place"].to_numpy(int)] == 1, "block", "allow")
        yield pdf.assign(rule=rule, verdict=verdict)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Each row of ``pages`` (with column url) without the url, plus host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule wins; no
    rule means ``default``. A url that is null or has no ``://`` has an empty host and path and fits no rule. Only
    A-Z is lower-cased. The rules' file is shipped to every executor by Spark, also to one that joins later, and is
    memory-mapped there; repeated rules count once, the last given wins.
    """
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not path.startswith("/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
    once = [(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()]
    folder = tempfile.mkdtemp(prefix="tidewell-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = write_rules(once, folder)
    pages.sparkSession.sparkContext.addFile(file)
    name, longest, lengths = os.path.basename(file), max((len(h) for _, h, _ in rules), default=0), sorted({len(p) for _, _, p in rules})
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")),
    }).drop("url")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(lambda it: _judge(it, name, longest, lengths, default), f"{kept}, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(v, h, pa) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, h || pa AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pa) DESC) AS n
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""
