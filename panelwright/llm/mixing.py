"""Mixing sources to target weights: budgets for the leaves of a domain-language-source tree, and the token
prefix of each leaf's seeded epochs that fills its budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, written

Path = tuple[str, ...]
#: Bits of a document's place that each round of the cut looks at, 63 in all.
ROUNDS = (13, 13, 13, 12, 12)
#: Rows of a leaf that one window takes at most.
WINDOW = 1 << 13


def token_count(text: str = "text") -> Column:
    """Words between white space; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def allocate(supply: Mapping[Path, int], weights: Mapping[Path, float], budget: float, max_epochs: int) -> dict[Path, int]:
    """Tokens for each leaf.

    From the root down, a node's tokens go to its children in proportion to their weights (1 where none is
    given; a weight of 0 gets nothing unless all have it). A child takes max_epochs times the supply below it
    at most; what it can't take goes to its siblings by their weights, and only what all of them together
    can't take is missing at the parent and goes to the parent's siblings. The total is the budget, or all
    there is. Fractions of a token are dropped.
    """
    capacity: dict[Path, float] = {}
    children: dict[Path, set[Path]] = {}
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0) + tokens * max_epochs
            if depth:
                children.setdefault(leaf[: depth - 1], set()).add(leaf[:depth])
    out: dict[Path, int] = {}

    def give(node: Path, tokens: float) -> None:
        if node not in children:
            out[node] = int(min(tokens, capacity[node]) + 1e-6)
            return
        own = sorted(children[node])
        weight = {c: max(0.0, float(weights.get(c, 1.0))) for c in own}
        if not any(weight.values()):
            weight = dict.fromkeys(own, 1.0)
        got, open_, left = dict.fromkeys(own, 0.0), {c for c in own if weight[c] > 0}, tokens
        while open_ and left > 1e-9:
            total = sum(weight[c] for c in sorted(open_))
            full = {c for c in open_ if capacity[c] - got[c] <= left * weight[c] / total + 1e-9}
            if not full:
                for c in open_:
                    got[c] += left * weight[c] / total
                break
            for c in sorted(full):
                left -= capacity[c] - got[c]
                got[c] = capacity[c]
            open_ -= full
        for c in own:
            give(c, got[c])

    if supply:
        give((), min(float(budget), capacity[()]))
    return out


def _key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """A document's place in an epoch: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), F.col(doc_id).cast("long")), 1)


def _leaf(levels: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"__leaf{i}") for i, c in enumerate(levels)]


def plan_mix(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], budget_share: float = 0.6, budget_tokens: int | None = None,
    max_epochs: int = 3, seed: int = 17, max_leaves: int = 100_000, text: str = "text",
) -> DataFrame:
    """(__leaf0 ..., __full, __last): each leaf's number of whole epochs, and the place in the epoch after them up to
    which documents are taken (-1 for none).

    The tree is of the size of the configuration: more than max_leaves leaves are an error. A leaf of any size
    is cut by totals: each round sums the documents in the open bucket by the next bits of their place, and opens
    the bucket in which the budget ends, until no leaf's has more than WINDOW rows or all bits are used and a
    bucket is one place. What is in it is then taken place by place. So no window has more than WINDOW rows.
    """
    spark, leaf = docs.sparkSession, [f"__leaf{i}" for i in range(len(levels))]
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_leaf(levels), token_count(text).alias("tokens")), "tokens")
    totals = slim.groupBy(*leaf).agg(F.sum("tokens").alias("supply")).limit(max_leaves + 1).collect()
    if len(totals) > max_leaves:
        raise ValueError(f"the tree of {', '.join(levels)} has more than {max_leaves} leaves")
    supply = {tuple(r[c] for c in leaf): int(r["supply"]) for r in totals}
    budget = budget_tokens if budget_tokens is not None else budget_share * sum(supply.values())
    given = allocate(supply, weights, budget, max_epochs)
    rows = [(*path, given[path] // n if n else 0, given[path] % n if n else 0) for path, n in sorted(supply.items())]
    share = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in leaf) + ", full long, rest long")
    inside = slim.join(F.broadcast(share), leaf).where("rest > 0").select(*leaf, "rest", "tokens", _key(seed, F.col("full") + 1).alias("key"))
    left, opened = 63, share.select(*leaf, F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("before"))
    for bits in ROUNDS:
        left -= bits
        bucket = F.shiftrightunsigned("key", left).alias("bucket")
        totals_of = inside.join(F.broadcast(opened), leaf).where(F.shiftrightunsigned("key", left + bits) == F.col("opened"))
        by_bucket = totals_of.groupBy(*leaf, "rest", "before", bucket).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))
        past = by_bucket.withColumn("upto", upto).where("upto > rest")
        # a row a leaf, max_leaves at most; a leaf without one takes all its documents
        found = [F.min("bucket").alias("opened"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"), F.min_by("rows", "bucket").alias("rows")]
        opened = written(past.groupBy(*leaf).agg(*found), "mix-round")
        if (opened.agg(F.max("rows")).first()[0] or 0) <= WINDOW:
            break
    held = inside.join(F.broadcast(opened.drop("rows")), leaf).where(F.shiftrightunsigned("key", left) == F.col("opened"))
    held = held.groupBy(*leaf, "rest", "before", "key").agg(F.sum("tokens").alias("n"))
    taken = held.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("key"))).where("upto <= rest")
    within = written(taken.groupBy(*leaf).agg(F.max("key").alias("within")), "mix-within")
    cuts = share.join(F.broadcast(opened), leaf, "left").join(F.broadcast(within), leaf, "left")
    below = F.shiftleft("opened", left) - 1
    last = F.when(F.col("rest") == 0, F.lit(-1).cast("long")).otherwise(F.coalesce("within", below, F.lit((1 << 63) - 1)))
    return written(cuts.select(*leaf, F.col("full").alias("__full"), last.alias("__last")), "cuts")


def mix(docs: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], text: str = "text", seed: int = 17, **how) -> DataFrame:
    """docs' rows, each as often as its leaf's budget takes it, with epoch (from 1) and tokens.

    A leaf's whole epochs hold all its documents; the one after them holds, in the order of a seeded hash of
    epoch and doc_id, the longest prefix whose tokens do not exceed the rest of the budget; rows that share a
    doc_id come or go together. Null levels are a leaf named by the empty string; null doc_ids have one place;
    null and empty texts have no tokens and come with the prefix they stand in; an empty table gives no rows.
    All columns of docs stay; where it has one named epoch or tokens, those here are mix_epoch and mix_tokens.
    """
    epoch, tokens = free_name(docs, "epoch"), free_name(docs, "tokens")
    cuts = plan_mix(docs, levels, weights, seed=seed, text=text, **how)
    cut = [free_name(docs, f"__cut{i}") for i in range(len(levels))]
    full, last, times = (free_name(docs, c) for c in ("__full", "__last", "__times"))
    same = [leaf == F.col(c) for c, leaf in zip(cut, _leaf(levels))]
    cuts = cuts.select(*(F.col(f"__leaf{i}").alias(c) for i, c in enumerate(cut)), F.col("__full").alias(full), F.col("__last").alias(last))
    joined = docs.join(F.broadcast(cuts), same)  # max_leaves rows at most
    joined = joined.withColumn(times, F.col(full) + (_key(seed, F.col(full) + 1) <= F.col(last)).cast("long"))
    chosen = joined.where(F.col(times) > 0).withColumn(tokens, token_count(text))
    chosen = chosen.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns), epoch, tokens)


#: The mixture of the query and of the pipeline's last stage: domains of the sources, then languages, then sources alike.
DOMAINS = {"src0": "crawl", **{f"src{i}": "reference" for i in range(1, 10)}}
WEIGHTS: dict[Path, float] = {
    ("crawl",): 0.3, ("reference",): 0.45, ("community",): 0.25,
    **{(d, lang): w for d in ("crawl", "reference", "community") for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))},
}


def mix_by_source(docs: DataFrame, weights: Mapping[Path, float] = WEIGHTS, **how) -> DataFrame:
    """The mixture of docs(doc_id, text, lang, source) over domain, language and source, with the domain of each
    row's source; sources that aren't listed are community. A column domain of docs stays, this one is
    mix_domain then."""
    domain = free_name(docs, "domain")
    known = F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv))
    placed = docs.withColumn(domain, F.coalesce(known[F.col("source")], F.lit("community")))
    return mix(placed, (domain, "lang", "source"), weights, **how)
