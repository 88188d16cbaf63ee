"""URL filter: gradient-boosted trees over lexical features, in SQL functions only.

Labels are the verdicts of the block and allow rules; URLs that no rule fits are judged by the trees.  Features are binned
numbers of the URL alone (length, depth, digits, entropy, parameters, host shape) and how common its suffix is in the table.
Labelled URLs are first summed per distinct vector of bins.  A level of a tree is then one aggregation: gradient and
curvature sums per node, feature and bin, a few hundred rows whatever the input, from which the splits are chosen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import cut

#: (verdict, host and path prefix); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TREES, DEPTH, RATE, RIDGE, BINS = 10, 3, 0.3, 1.0, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL and where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; NULL where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        owner, _, start = rule.partition("/")
        fits = ((host == owner) | host.endswith("." + owner)) & path.startswith("/" + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _bin(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(value).cast("int")))


def features(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, ruled (verdict of the rule) and the binned features f0, f1, ..."""
    host, path = parts(F.col(url_column))
    base = pages.withColumn("host", host).withColumn("path", path)
    rule, ruled = matched_rule(F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("_suffix", F.substring_index("host", ".", -1))
    common = base.groupBy(F.col("_suffix").alias("_name")).agg(F.count("*").alias("_seen"))
    total = common.agg(F.sum("_seen")).first()[0] or 1
    base = base.join(common, F.col("_suffix") == F.col("_name"))
    url = F.coalesce(F.col(url_column), F.lit(""))
    n = F.length(url)
    letters = F.split(url, "")
    each = F.transform(F.array_distinct(letters), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    size = F.greatest(n, F.lit(1)).cast("double")
    entropy = F.aggregate(each, F.lit(0.0), lambda a, k: a - F.when(k > 0, k / size * F.log2(k / size)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = [
        n / 8, F.length("host") / 4, F.regexp_count("path", F.lit("/+[^/]")), F.regexp_count(url, F.lit("[0-9]")) / size * 2 * BINS,
        entropy * 3, F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), F.regexp_count("host", F.lit("[.]")),
        F.regexp_count(url, F.lit("[-_]")), F.length("_suffix"), -F.log2(F.col("_seen") / F.lit(float(total))) * 2,
        F.length("path") / 4, F.regexp_count(url, F.lit("%")) ]
    return base.select("*", *[_bin(c).alias(f"f{i}") for i, c in enumerate(columns)]).drop("_suffix", "_name", "_seen")


N_FEATURES = 12


@dataclass(frozen=True)
class Split:
    feature: int
    below: int  # rows whose bin is less go left
    left: Split | float
    right: Split | float

    def column(self) -> Column:
        side = [x.column() if isinstance(x, Split) else F.lit(float(x)) for x in (self.left, self.right)]
        return F.when(F.col(f"f{self.feature}") < self.below, side[0]).otherwise(side[1])


@dataclass
class Boosted:
    prior: float
    trees: list[Split | float]

    def margin(self) -> Column:
        return reduce(lambda a, t: a + (t.column() if isinstance(t, Split) else F.lit(float(t))), self.trees, F.lit(self.prior))


def _best(hist: list[tuple[int, int, float, float]]) -> tuple[float, int, int] | None:
    """Highest gain over all cuts of one node's histogram; ties go to the first feature and bin."""
    best = None
    total_g, total_h = (sum(r[i] for r in hist if r[0] == 0) for i in (2, 3))
    for f in range(N_FEATURES):
        g = h = 0.0
        for b, dg, dh in sorted((r[1], r[2], r[3]) for r in hist if r[0] == f):
            if h > 0 and total_h - h > 1e-9:
                gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g ** 2 / (total_h + RIDGE)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, b)
            g, h = g + dg, h + dh
    return best


def _node(k: int, splits: dict[int, tuple[int, int]]) -> Column:
    """Number of the node that a row has reached below node ``k``; the children of k are 2 k and 2 k + 1."""
    if k not in splits:
        return F.lit(k)
    feature, below = splits[k]
    return F.when(F.col(f"f{feature}") < below, _node(2 * k, splits)).otherwise(_node(2 * k + 1, splits))


def train(vectors: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees from rows (f0, ..., n, blocked): labelled URLs per vector of bins and how many of them are to be blocked."""
    n, blocked = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    model = Boosted(math.log((blocked + 0.5) / (n - blocked + 0.5)), [])
    if not 0 < blocked < n:
        return model
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        rows = vectors.withColumn("g", F.col("blocked") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))
        splits: dict[int, tuple[int, int]] = {}
        values: dict[int, float] = {}
        open_nodes = {1}
        for level in range(depth + 1):
            node = _node(1, splits)
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("b")) for i in range(N_FEATURES)]))
            # nodes of a level times features times bins: at most 2 ** depth * N_FEATURES * BINS rows
            sums = (rows.select(node.alias("node"), "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.b")
                    .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
            by_node: dict[int, list] = {}
            for r in sums:
                by_node.setdefault(r["node"], []).append((r["f"], r["b"], r["g"], r["h"]))
            following = set()
            for k in sorted(open_nodes):
                hist = by_node.get(k, [])
                g, h = (sum(r[i] for r in hist if r[0] == 0) for i in (2, 3))
                values[k] = rate * g / (h + RIDGE)
                cut_at = _best(hist) if level < depth else None
                if cut_at:
                    splits[k] = (cut_at[1], cut_at[2])
                    following |= {2 * k, 2 * k + 1}
            open_nodes = following
            if not open_nodes:
                break

        def grow(k: int) -> Split | float:
            return Split(*splits[k], grow(2 * k), grow(2 * k + 1)) if k in splits else values[k]

        model.trees.append(grow(1))
    return model


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score (the trees' probability of block).

    The verdict is the fitting rule's, else block where block_score is at least 0.5.  NULL URLs are judged like empty ones;
    with labels of one class alone, or none, the score is the smoothed share of block.  Repeated rows are judged alike.
    """
    known = features(pages.select(id_column, url_column), url_column)
    names = [f"f{i}" for i in range(N_FEATURES)]
    vectors = cut(known.filter("ruled is not null").groupBy(*names).agg(
        F.count("*").alias("n"), F.sum((F.col("ruled") == "block").cast("int")).alias("blocked")))
    score = 1 / (1 + F.exp(-train(vectors).margin()))
    return known.withColumn("block_score", score).select(
        id_column, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
