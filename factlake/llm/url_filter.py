"""Operator 12: URL filters. Rules on hosts and paths first, gradient-boosted trees on lexical features for the rest.

Features are lengths, depth, shares of digits and vowels, entropies, numbers of parameters, hyphens
and escapes, and statistics of host suffixes and host words: how far the labelled URLs with such a
suffix or word lean to block. All are computed from the URL alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.boosting import BoostedTrees, fit
from factlake.llm.tables import Scratch, map_rows, pieces

#: labelled URLs of the table that are learned from, those with the smallest hashes; their bytes that count
TRAINING_ROWS, TRAINING_BYTES = 20_000, 2_048
#: bytes of rules by host that are broadcast; beyond that they are joined
RULE_BYTES = 64 << 20
#: weight of the overall share in the statistics of a suffix or word
PRIOR = 4.0

# fixed values: words of hosts that blocklists of public interest carry, and words of ordinary hosts
BLOCK_WORDS = (
    "adult", "ads", "adserver", "bets", "betting", "bonus", "casino", "cheap", "cracked", "dating", "escort", "farm", "fake", "free", "gambling",
    "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker",
    "viagra", "warez", "win", "winner", "xxx",
)
PLAIN_WORDS = (
    "academy", "archive", "bakery", "bridge", "city", "clinic", "college", "cook", "daily", "docs", "forum", "garden", "guide", "harbor", "health",
    "history", "home", "journal", "lab", "library", "market", "museum", "music", "news", "north", "paper", "park", "planet", "post", "press",
    "radio", "review", "river", "school", "science", "shop", "sport", "studio", "times", "travel", "union", "valley", "weather", "wiki", "works",
)
#: words that name a blocked site by themselves; the other ones also stand in ordinary hosts
STRONG_WORDS = ("adult", "adserver", "betting", "casino", "escort", "gambling", "jackpot", "keygen", "lottery", "nude", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")

_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """Judges the host and all its subdomains where the path starts as the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parsed(url) -> tuple:
    """Columns host and path of a URL column; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and columns rule and verdict of the longest rule (host, path, verdict) that fits, null if none does.

    Rules are gathered by host and met once for each number of labels that a rule's host has, so
    rows are never multiplied. Of rules of one length the one with the longer host, then the lesser
    name and verdict wins.
    """
    by_host = rules.groupBy(F.col("host").alias("__host")).agg(F.collect_set(F.struct(F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("__rules"))
    by_host = Scratch(urls.sparkSession, "rules").save(by_host.withColumn("__labels", F.size(F.split("__host", r"\."))), "hosts")
    sizes = by_host.groupBy("__labels").agg(F.sum(F.length("__host") + F.aggregate("__rules", F.lit(0), lambda n, r: n + F.length(r["rule"]) + 32)).alias("bytes")).collect()  # one row for each number of labels
    labels = F.split("host", r"\.")
    best = F.lit(None)
    out = urls
    for k, (n, size) in enumerate(sorted((r["__labels"], r["bytes"]) for r in sizes)):
        level = by_host.where(F.col("__labels") == n).select(F.col("__host").alias(f"__host{k}"), F.col("__rules").alias(f"__rules{k}"))
        level = F.broadcast(level) if size <= RULE_BYTES else level
        suffix = F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, -n, n)))
        out = out.withColumn("__suffix", suffix).join(level, F.col("__suffix") == F.col(f"__host{k}"), "left")
        fits = F.filter(f"__rules{k}", lambda r: F.startswith(F.col("path"), r["path"]))
        first = F.array_sort(fits, lambda a, b: F.when(a["long"] != b["long"], b["long"] - a["long"]).when(a["rule"] != b["rule"], F.when(a["rule"] < b["rule"], -1).otherwise(1)).when(a["verdict"] < b["verdict"], -1).otherwise(1))
        found = F.get(first, 0)
        out = out.withColumn(f"__found{k}", found).drop("__suffix", f"__host{k}", f"__rules{k}")
        best = F.col(f"__found{k}") if k == 0 else F.when(F.col(f"__found{k}").isNotNull() & (F.col("__best").isNull() | (F.col(f"__found{k}.long") >= F.col("__best.long"))), F.col(f"__found{k}")).otherwise(F.col("__best"))
        out = out.withColumn("__best", best).drop(f"__found{k}")
    if not sizes:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.col("__best.verdict")}).drop("__best")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * log(c / n, 2) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    """The last one, two and three labels of a host, its words and the words' runs of four letters; marked so that none is taken for another."""
    labels = host.split(".")
    words = sorted({w for w in _SPLIT.split(host) if w})
    runs = sorted({w[k : k + 4] for w in words for k in range(len(w) - 3)})
    return ["." + ".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k] + words + ["~" + r for r in runs]


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "longest_label", "digits", "host_digits", "vowels", "url_entropy", "host_entropy",
    "parameters", "longest_value", "hyphens", "escapes", "numeric_host", "suffix_1", "suffix_2", "suffix_3", "word_highest", "word_sum", "run_highest", "run_mean",
)


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of a URL that need no statistics."""
    query = url.partition("?")[2].partition("#")[0]
    values = [p.partition("=")[2] for p in query.split("&")] if query else []
    labels = host.split(".")
    share = lambda text, chars: sum(c in chars for c in text) / len(text) if text else 0.0
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), max(map(len, labels)), share(url, "0123456789"), share(host, "0123456789"), share(host, "aeiou"), entropy(url), entropy(host),
        len(values), max(map(len, values), default=0), host.count("-"), url.count("%"), float(host.replace(".", "").isdigit()),
    ]


class UrlModel:
    """Statistics of suffixes and words, and trees over all features."""

    def __init__(self, rows: Sequence[tuple[str, str, str, int]], trees: int = 40, depth: int = 3) -> None:
        """Rows are (url, host, path, 1 for block). A row's own label is left out of the statistics it is trained with."""
        self.seen: dict[str, tuple[int, int]] = {}
        blocked = sum(r[3] for r in rows)
        self.share = blocked / len(rows)
        n, yes = Counter(), Counter()
        parts = [suffixes(r[1]) for r in rows]
        for (*_, y), keys in zip(rows, parts, strict=True):
            n.update(keys)
            yes.update(keys * y)
        self.seen = {k: (c, yes[k]) for k, c in n.items()}
        x = np.array([lexical(*r[:3]) + self.statistics(p, r[3]) for r, p in zip(rows, parts, strict=True)])
        self.trees: BoostedTrees = fit(x, np.array([r[3] for r in rows], float), trees, depth)

    def lean(self, key: str, own: int | None = None) -> float:
        """Log-odds of block among the labelled URLs with a suffix or word, drawn to the overall share."""
        n, yes = self.seen.get(key, (0, 0))
        if own is not None:
            n, yes = n - 1, yes - own
        share = (yes + PRIOR * self.share) / (n + PRIOR)
        return log(share / (1 - share))

    def statistics(self, keys: list[str], own: int | None = None) -> list[float]:
        ends = [self.lean(k, own) for k in keys if k[0] == "."]
        words = [self.lean(k, own) - self.lean("") for k in keys if k[0] not in ".~"]
        runs = [self.lean(k, own) - self.lean("") for k in keys if k[0] == "~"]
        return [*ends, *[self.lean("")] * (3 - len(ends)), max(words, default=0.0), sum(words), max(runs, default=0.0), sum(runs) / max(1, len(runs))]

    def scores(self, rows: Sequence[tuple[str, str, str]]) -> np.ndarray:
        """Probability of block."""
        x = np.array([lexical(*r) + self.statistics(suffixes(r[1])) for r in rows]).reshape(len(rows), len(FEATURES))
        return 1 / (1 + np.exp(-self.trees.logits(x)))


def seed_urls(per_class: int = 1200) -> list[tuple[str, str, str, int]]:
    """Labelled URLs made from the word lists, so that both labels can always be learned; the same every time."""
    rnd = random.Random(12)
    out = []
    for k, y in product(range(per_class), (0, 1)):
        words = PLAIN_WORDS if not y else BLOCK_WORDS
        first = words[k % len(words)]
        second = rnd.choice(words) if y or rnd.random() < 0.5 else "".join(rnd.choice("aeioubcdfghklmnprst") for _ in range(rnd.randrange(3, 9)))
        name = first + rnd.choice(["-", "-", ""] if y else ["-", "", "", ""]) + second + (str(rnd.randrange(1000)) if rnd.random() < (0.3 if y else 0.05) else "")
        host = rnd.choice(["", "www.", "blog.", "m."]) + name + rnd.choice([".com", ".net", ".org", ".example.com", ".example.net", ".example.org"])
        path = "/" + "/".join(rnd.choice(["en", "de", "fr", "es", str(rnd.randrange(10**6)), rnd.choice(PLAIN_WORDS)]) for _ in range(rnd.randrange(1, 4)))
        tail = rnd.choice(["", "", ".html", "/", "?page=2&ref=x", "?utm_source=feed", "#top"])
        url = f"{rnd.choice(['http', 'https'])}://{host}{path}{tail}"
        out.append((url, host, path + tail if tail in (".html", "/") else path, y))
    return out


def train(labelled: DataFrame, *, training_rows: int = TRAINING_ROWS) -> UrlModel:
    """Learns from (url, host, path, label) rows, at most ``training_rows`` of them, and from the seed.

    Rows are taken by the smallest hash of the URL, ties by the URL; of each URL the first TRAINING_BYTES
    count. This bound is the classifier's only one; scores read whole URLs.
    """
    short = labelled.select(*(F.substring(c, 1, TRAINING_BYTES).alias(c) for c in ("url", "host", "path")), F.col("label").cast("int").alias("label")).where("host <> '' and label is not null").distinct()
    sample = short.orderBy(F.xxhash64("url"), "url", "label").limit(training_rows).collect()
    return UrlModel([*seed_urls(), *(tuple(r) for r in sample)])


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, *, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``, judged by its whole URL.

    ``rules`` are a few rules, or a table (host, path, verdict) of any size. ``labelled`` has rows
    (url, label), 1 for block; left out, the table labels itself: URLs whose host holds one of
    STRONG_WORDS are block, others are allow where an allow rule fits. The trees' verdict is block
    from ``cut`` on and counts where no rule fits. Null URLs and those without ``://`` have an empty host and
    path, no rule, and are judged like any other. Empty and very long URLs, repeated rows, null ids and
    clashing other columns are judged row by row; an empty table gives an empty result. Nothing is
    shuffled but the labelled sample.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    host, path = parsed(F.col("url"))
    placed = lambda df: df.withColumns({"host": host, "path": path})
    urls = matched(placed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))), rules)
    if labelled is None:
        strong = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*map(F.lit, STRONG_WORDS)))
        labelled = urls.withColumn("label", F.when(strong, 1).when(F.col("verdict") == "allow", 0))
    else:
        labelled = placed(labelled.select("url", "label"))
    model = spark.sparkContext.broadcast(train(labelled, training_rows=training_rows))
    names = ["page_id", "host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            ids, url, hosts, paths, rule, verdict = batch.columns
            score = model.value.scores(list(zip(url.to_pylist(), hosts.to_pylist(), paths.to_pylist(), strict=True)))
            judged = [v or ("block" if s >= cut else "allow") for v, s in zip(verdict.to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, rule, pa.array(judged, pa.string()), pa.array(score, pa.float64())], names)

    return map_rows(urls.select("page_id", "url", "host", "path", "rule", "verdict"), run, "page_id long, host string, path string, rule string, verdict string, score double")


#: the rules of the registered query
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
