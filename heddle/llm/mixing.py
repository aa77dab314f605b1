"""Mixing sources to target weights by hierarchical budgets (operator 1); DataFrame functions only.

A tree of columns (domain, language, source) gets a token budget at its root. Each node splits its budget among its children
by their weights; what a child cannot use (it has tokens x max_epochs at most) goes to its siblings by their weights, and only
what no sibling can use is left to the node's own siblings, as a node never asks for more than all below it have.

A leaf's budget is whole epochs of its documents and a rest. The rest is a prefix of the next epoch's order, by
md5(seed:epoch:doc_id): documents are taken while the tokens of those before them are fewer than the rest. The cut is found
by sums over hash prefixes, so that no task orders a whole leaf, and is one key a leaf; texts are never shuffled.

An empty table gives no rows; very long texts are counted whole and taken or left whole; other columns stay as they are, whatever
their names, but for those that are added (_t_ and each tree column's name, _epoch), which are replaced. Nulls in tree columns are the node of the empty string, null texts have no tokens, rows of equal doc_id are ordered as one
(all or none in a prefix). Nodes that no weight names weigh default_weight; nodes of weight 0 get nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, salted_join, written


def n_words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def weight(names: Column, weights: Mapping[str, float], default_weight: float) -> Column:
    """Of a node by its own name; a parameter of a few entries."""
    return reduce(lambda other, kv: F.when(names == kv[0], float(kv[1])).otherwise(other), weights.items(), F.lit(float(default_weight)))


def split(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes (parents.., name, w, cap, given: the parent's budget) with budget, at most cap.

    Siblings ascend by cap/w; while a node's cap is within its share of what is left, it gets all of it; the rest share."""
    own = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = own.orderBy((F.col("cap") / F.col("w")).asc(), "name")
    live = nodes.filter("w > 0")
    live = live.withColumns({"before": F.sum("cap").over(ordered) - F.col("cap"), "weights": F.sum("w").over(own) - F.sum("w").over(ordered) + F.col("w")})
    live = live.withColumn("level", (F.col("given") - F.col("before")) / F.col("weights"))
    live = live.withColumn("full", F.col("cap") <= F.col("level") * F.col("w") + 1e-6)
    live = live.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(own))
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("level") * F.col("w") + 1e-6)).cast("long")
    return live.withColumn("budget", F.greatest(budget, F.lit(0))).drop("before", "weights", "level", "full")


def budgets(leaves: DataFrame, tree: list[str], budget: float, weights: Mapping[str, Mapping[str, float]], max_epochs: int, default_weight: float) -> DataFrame:
    """leaves (tree.., tokens) -> (tree.., tokens, budget). A row a leaf; budget: tokens, as a share of all tokens there are."""
    levels = [leaves.groupBy(*tree[: k + 1]).agg((F.sum("tokens") * max_epochs).alias("cap")) for k in range(len(tree))]
    given = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * float(budget)).alias("given"))
    above = None
    for k, nodes in enumerate(levels):
        nodes = nodes.withColumn("name", F.col(tree[k])).withColumn("w", weight(F.col("name"), weights.get(tree[k], {}), default_weight))
        nodes = nodes.crossJoin(F.broadcast(given)) if above is None else nodes.join(above, tree[:k])  # given is one row
        above = split(nodes, tree[:k]).select(*tree[: k + 1], F.col("budget").alias("given"))
    return leaves.join(above, tree, "left").select(*tree, "tokens", F.coalesce("given", F.lit(0)).cast("long").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cuts(slim: DataFrame, leaves: DataFrame, tree: list[str], seed: int, digits: tuple[int, ...] = (2, 4)) -> DataFrame:
    """leaves (tree.., tokens, budget) -> (tree.., epochs, cut): whole epochs, and the last key taken of the next, if any."""
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")
    leaves = leaves.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    leaves = written(leaves.select(*tree, "epochs", "rest"))
    rows = salted_join(slim, leaves.filter("rest > 0"), tree).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    rows = written(rows.select(*tree, "key", "n_tokens", "rest"))
    left = "rest"
    for n in digits:  # to the prefix in which the rest ends; what lies before it is taken off
        sums = rows.groupBy(*tree, F.substring("key", 1, n).alias("part")).agg(F.sum("n_tokens").alias("t"), F.first(left).alias("r"))
        own = Window.partitionBy(*tree).orderBy("part")
        sums = sums.withColumn("past", F.sum("t").over(own) - F.col("t")).filter(F.col("past") < F.col("r"))
        last = sums.groupBy(*tree).agg(F.max_by(F.struct("part", (F.col("r") - F.col("past")).alias("more")), "part").alias("at")).select(*tree, "at.*")
        last = written(last.withColumnsRenamed({"part": "_part", "more": "_more"}))
        rows = salted_join(rows.drop("_more"), last, tree).filter(F.substring("key", 1, n) == F.col("_part")).drop("_part")
        left = "_more"
    own = Window.partitionBy(*tree).orderBy("key")
    keys = rows.groupBy(*tree, "key").agg(F.sum("n_tokens").alias("t"), F.first("_more").alias("r"))
    keys = keys.withColumn("past", F.sum("t").over(own) - F.col("t")).filter(F.col("past") < F.col("r"))
    cut = keys.groupBy(*tree).agg(F.max("key").alias("cut"))
    return written(leaves.join(cut, tree, "left").select(*tree, "epochs", "cut"))


def named(docs: DataFrame, tree: Mapping[str, Column]) -> DataFrame:
    return docs.withColumns({f"_t_{k}": F.coalesce(c.cast("string"), F.lit("")) for k, c in tree.items()})


def plan(docs: DataFrame, tree: Mapping[str, Column], budget: float = 1.0, weights: Mapping[str, Mapping[str, float]] | None = None, max_epochs: int = 1, seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """A row a leaf (_t_<column>.., epochs, cut), from every row of docs (doc_id, text, and what tree is made of)."""
    names = [f"_t_{k}" for k in tree]
    slim = written(named(docs, tree).select(*names, "doc_id", n_words(F.col("text")).alias("n_tokens")))
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    by_name = {f"_t_{k}": v for k, v in (weights or {}).items()}
    return cuts(slim, written(budgets(written(leaves), names, budget, by_name, max_epochs, default_weight)), names, seed)


def mixed(docs: DataFrame, tree: Mapping[str, Column], seed: int = 7, **how) -> DataFrame:
    """docs' rows as often as they are taken, with _epoch (0 first) and the tree's columns as _t_<column>."""
    names = [f"_t_{k}" for k in tree]
    rows = salted_join(named(docs, tree), plan(docs, tree, seed=seed, **how).withColumnsRenamed({"epochs": "_heddle_epochs", "cut": "_heddle_cut"}), names)
    more = F.col("_heddle_cut").isNotNull() & (order_key(seed, F.col("_heddle_epochs"), F.col("doc_id")) <= F.col("_heddle_cut"))
    times = F.col("_heddle_epochs") + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("_heddle_times", times).filter("_heddle_times > 0")
    return rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_heddle_times") - 1))).drop("_heddle_times", "_heddle_epochs", "_heddle_cut")


def tree() -> dict[str, Column]:
    """Sources 0 to 9 and those without a number are the domain web, the others curated."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"([0-9]{1,6})$", 1)
    return {"domain": F.when(number.isin("", *map(str, range(10))), "web").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}


#: With tree(), what the registered queries mix by.
WEIGHTS = {"domain": {"web": 0.5, "curated": 0.5}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "source": {"src0": 2.0}}


def _sql_level(name: str, above: str | None, cols: list[str], w: str) -> str:
    """One level of the tree in SQL: {name}(cols.., given)."""
    parent, part = cols[:-1], ", ".join(cols[:-1]) or "1"
    source = f"(SELECT {', '.join(cols)}, sum(tokens) * {{epochs}} AS cap FROM leaves GROUP BY ALL) n " + (f"JOIN {above} p USING ({', '.join(parent)})" if above else "CROSS JOIN root p")
    return f"""
{name}0 AS (SELECT {', '.join('n.' + c for c in cols)}, CAST(n.cap AS DOUBLE) AS cap, p.given, {w} AS w FROM {source}),
{name}1 AS (SELECT *, sum(cap) OVER o - cap AS past, sum(w) OVER (PARTITION BY {part}) - sum(w) OVER o + w AS ws FROM {name}0
  WINDOW o AS (PARTITION BY {part} ORDER BY cap / w, {cols[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}2 AS (SELECT *, (given - past) / ws AS lv, cap <= (given - past) / ws * w + 1e-6 AS is_full FROM {name}1),
{name} AS (SELECT {', '.join(cols)}, greatest(0, CAST(CASE WHEN is_full THEN cap
  ELSE floor(max(CASE WHEN NOT is_full THEN lv END) OVER (PARTITION BY {part}) * w + 1e-6) END AS BIGINT)) AS given FROM {name}2)"""


def oracle(budget: float, max_epochs: int, seed: int, documents: str = "documents") -> str:
    case = lambda c, ws: "CASE " + " ".join(f"WHEN n.{c} = '{k}' THEN {float(v)}" for k, v in ws.items()) + " ELSE 1.0 END"
    cols = ["domain", "lang", "source"]
    levels = ",".join(_sql_level(f"l{k}", f"l{k - 1}" if k else None, cols[: k + 1], case(c, WEIGHTS[c])) for k, c in enumerate(cols))
    return f"""WITH slim AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1) IN ('', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN 'web' ELSE 'curated' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM slim GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {float(budget)}) AS given FROM leaves),{levels.replace('{epochs}', str(max_epochs))},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN CAST(given // tokens AS BIGINT) ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM leaves l JOIN l2 USING (domain, lang, source)),
keyed AS (SELECT s.*, p.epochs, p.rest, md5('{seed}:' || p.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM slim s JOIN plan p USING (domain, lang, source)),
past AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
  - sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS before FROM keyed),
times AS (SELECT *, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS n FROM past)
"""
