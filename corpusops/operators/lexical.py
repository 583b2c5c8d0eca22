"""Search strings and the cover-density text score.

A search string is a choice (``or``) of clauses. A clause asks for all of its items; an item is
a word or a quoted phrase; a leading ``-`` forbids the item. The score of a clause follows cover
density: every shortest stretch of text that holds all items adds 0.1 / (1 + other words in it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions.text import TOKEN_BREAK, bind, words
from corpusops.session import stored

CHUNK = r'-?"[^"]*"?|\S+'

# three short strings a row: a few megabytes at most
BROADCAST_ROWS = 100_000


def _parts(query: Column) -> Column:
    """Pieces of the search string: or-marker, negation, phrase flag, tokens."""
    found = F.regexp_extract_all(query, F.lit(CHUNK), F.lit(0))
    parts = F.transform(
        found,
        lambda c: F.struct(
            (F.lower(c) == "or").alias("is_or"),
            F.startswith(c, F.lit("-")).alias("negated"),
            c.contains('"').alias("phrase"),
            F.filter(F.split(F.lower(c), TOKEN_BREAK, -1), lambda t: t != "").alias("tokens"),
        ),
    )
    return F.filter(parts, lambda p: p["is_or"] | (F.size(p["tokens"]) > 0))


def _items(parts: Column) -> Column:
    """A phrase is one item of several tokens; any other part gives one item per token."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                parts,
                lambda p: F.when(p["phrase"], F.array(p["tokens"])).otherwise(
                    F.transform(p["tokens"], lambda t: F.array(t))
                ),
            )
        )
    )


def clauses(query: Column) -> Column:
    """array<struct<clause, items, forbidden>>; a clause without items matches nothing."""
    def numbered(parts: Column) -> Column:
        ors = F.filter(
            F.transform(parts, lambda p, i: F.when(p["is_or"], i)), lambda i: i.isNotNull()
        )
        return bind(
            F.concat(F.array(F.lit(-1)), ors),
            lambda cuts: F.transform(
                cuts,
                lambda cut, k: bind(
                    F.slice(
                        parts, cut + 2,
                        F.greatest(F.coalesce(F.get(cuts, k + 1), F.size(parts)) - cut - 1, F.lit(0)),
                    ),
                    lambda mine: F.struct(
                        k.alias("clause"),
                        _items(F.filter(mine, lambda p: ~p["negated"])).alias("items"),
                        _items(F.filter(mine, lambda p: p["negated"])).alias("forbidden"),
                    ),
                ),
            ),
        )

    return F.filter(bind(_parts(query), numbered), lambda c: F.size(c["items"]) > 0)


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """One row per term: query, clause, kind (word, phrase, not) and the term's words."""
    per = queries.select(key, F.explode(clauses(F.col(text))).alias("c"))
    tagged = per.select(
        key, F.col("c.clause").alias("clause"),
        F.explode(
            F.concat(
                F.transform("c.items", lambda i: F.struct(i.alias("item"), F.lit(False).alias("neg"))),
                F.transform("c.forbidden", lambda i: F.struct(i.alias("item"), F.lit(True).alias("neg"))),
            )
        ).alias("t"),
    )
    return tagged.select(
        key, "clause",
        F.when(F.col("t.neg"), "not").when(F.size("t.item") > 1, "phrase").otherwise("word").alias("kind"),
        F.array_join("t.item", " ").alias("term"),
    )


def _starts(tokens: Column, hits: Column, item: Column) -> Column:
    """Positions (0-based) where the item's words stand next to each other."""
    at = F.filter(
        hits,
        lambda h: (h["t"] == item[0])
        & ((F.size(item) == 1) | (F.slice(tokens, h["p"] + 1, F.size(item)) == item)),
    )
    return F.transform(at, lambda h: h["p"])


def covers(occurrences: Column, n_items: Column) -> Column:
    """Sum over minimal covers; ``occurrences`` is sorted by position."""
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("i"))
    start = F.struct(
        F.array_repeat(none, n_items).alias("last"),
        F.lit(0).alias("i"),
        F.lit(-1).alias("prev"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, o: Column) -> Column:
        def scored(last: Column) -> Column:
            def with_start(s: Column) -> Column:
                width = (o["p"] - s["p"]) - (acc["i"] - s["i"])
                gain = F.when(
                    (s["p"] >= 0) & (s["p"] != acc["prev"]), F.lit(0.1) / (1 + width).cast("double")
                ).otherwise(0.0)
                return F.struct(
                    last.alias("last"),
                    (acc["i"] + 1).alias("i"),
                    s["p"].alias("prev"),
                    (acc["score"] + gain).alias("score"),
                )

            return bind(F.array_min(last), with_start)

        seen = F.transform(
            acc["last"],
            lambda v, k: F.when(
                k == o["k"], F.struct(o["p"].alias("p"), acc["i"].alias("i"))
            ).otherwise(v),
        )
        return bind(seen, scored)

    return F.aggregate(occurrences, start, step, lambda acc: acc["score"])


def clause_score(tokens: Column, items: Column, forbidden: Column) -> Column:
    """Cover density of one clause over a text's tokens, computed inside the row."""
    def over_hits(hits: Column) -> Column:
        occurrences = F.array_sort(
            F.flatten(
                F.transform(
                    items,
                    lambda it, k: F.transform(
                        _starts(tokens, hits, it), lambda p: F.struct(p.alias("p"), k.alias("k"))
                    ),
                )
            )
        )
        banned = F.exists(forbidden, lambda it: F.size(_starts(tokens, hits, it)) > 0)
        return F.when(banned, 0.0).otherwise(covers(occurrences, F.size(items)))

    return bind(
        F.concat(F.flatten(items), F.flatten(forbidden)),
        lambda vocabulary: bind(
            F.filter(
                F.transform(tokens, lambda t, i: F.struct(i.alias("p"), t.alias("t"))),
                lambda h: F.array_contains(vocabulary, h["t"]),
            ),
            over_hits,
        ),
    )


def query_score(tokens: Column, query_clauses: Column) -> Column:
    return F.aggregate(
        query_clauses,
        F.lit(0.0),
        lambda acc, c: acc + clause_score(tokens, c["items"], c["forbidden"]),
    )


def _holds_all(text: Column, items: Column) -> Column:
    return bind(
        F.lower(text),
        lambda low: F.forall(items, lambda it: F.forall(it, lambda w: F.contains(low, w))),
    )


def may_match(text: Column, query_clauses: Column) -> Column:
    """Cheap necessary condition on the raw text, so most rows are never cut into tokens."""
    return bind(
        F.lower(text),
        lambda low: F.exists(
            query_clauses,
            lambda c: F.forall(c["items"], lambda it: F.forall(it, lambda w: F.contains(low, w))),
        ),
    )


def text_score(text: Column, query: Column) -> Column:
    return bind(
        clauses(query),
        lambda cs: F.when(
            may_match(text, cs), bind(words(text), lambda toks: query_score(toks, cs))
        ).otherwise(0.0),
    )


def text_topk(chunks: DataFrame, query: str, pool: int) -> DataFrame:
    """Best ``pool`` chunks by text score. There is no match condition: zero scores fill up."""
    scored = chunks.select("chunk_id", text_score(F.col("text"), F.lit(query)).alias("text_score"))
    return scored.orderBy(F.desc("text_score"), "chunk_id").limit(pool)


def text_matches(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, text_score) of every chunk that scores above zero, for many queries.

    Each clause is looked up by its rarest word only (by document count), so a clause meets the
    chunks that hold that word and no others. The candidates are written down and counted: while
    they are few enough to be broadcast, texts are scored inside their rows and not shuffled.
    """
    wanted = queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.explode(clauses(F.col("text"))).alias("c")
    ).select("query_id", "c.clause", "c.items", "c.forbidden")
    asked = wanted.select(
        "query_id", "clause", F.explode(F.array_distinct(F.flatten("items"))).alias("word")
    )
    holds = chunks.select(
        "chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")
    ).join(asked.select("word").distinct(), "word", "left_semi")
    frequency = holds.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    anchors = (
        asked.join(frequency, "word", "left")
        .groupBy("query_id", "clause")
        .agg(F.min(F.struct(n.alias("n"), F.col("word"))).alias("rarest"))
        .filter(F.col("rarest.n") > 0)
        .select("query_id", "clause", F.col("rarest.word").alias("word"))
    )
    candidates = stored(holds.join(anchors, "word").select("chunk_id", "query_id", "clause"), "candidates")
    few = candidates.count() <= BROADCAST_ROWS
    scored = (
        chunks.select("chunk_id", "text")
        .join(F.broadcast(candidates) if few else candidates, "chunk_id")
        .join(wanted, ["query_id", "clause"])
        .filter(_holds_all(F.col("text"), F.col("items")))
        .select(
            "query_id", "chunk_id",
            bind(
                words(F.col("text")),
                lambda toks: clause_score(toks, F.col("items"), F.col("forbidden")),
            ).alias("s"),
        )
    )
    return (
        scored.groupBy("query_id", "chunk_id")
        .agg(F.sum("s").alias("text_score"))
        .filter(F.col("text_score") > 0)
    )


def text_topk_batch(chunks: DataFrame, queries: DataFrame, pool: int, matched: DataFrame | None = None) -> DataFrame:
    """Best ``pool`` chunks of every query, zero scores filling up in chunk_id order.

    ``matched`` are the scores above zero where a stored word index has given them already. At most ``pool`` fillers per query are ever needed and they are among the ``pool`` smallest
    ids plus the matches, so they come from one list of ``pool`` ids, not from the corpus.
    """
    if matched is None:
        matched = text_matches(chunks, queries)
    first_ids = chunks.select("chunk_id").orderBy("chunk_id").limit(pool)
    listed = first_ids.agg(F.collect_list("chunk_id").alias("ids"))
    fillers = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.explode(listed.scalar()).alias("chunk_id"),
        F.lit(0.0).alias("text_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("text_score"), "chunk_id")
    return (
        matched.unionByName(fillers)
        .groupBy("query_id", "chunk_id")
        .agg(F.max("text_score").alias("text_score"))
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= pool)
        .drop("rn")
    )
