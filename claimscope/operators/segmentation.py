"""Unknown words in texts without blanks: a hidden Markov model over the places of characters in words.

A character begins a word, stands in its middle, ends it or is a word of its own. Spark counts how often texts begin with
each state, how often one state follows another, and which characters each state has; the model is a table, so it is
stored, read and joined like any other. A run that no dictionary knows is cut by the most probable sequence of states.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Begin, middle, end, single.
STATES = ("B", "M", "E", "S")
#: Which states may follow which; a text begins with B or S and ends with E or S.
FOLLOWS = {"B": ("M", "E"), "M": ("M", "E"), "E": ("B", "S"), "S": ("B", "S")}
FIRST, LAST = ("B", "S"), ("E", "S")
#: A model with so many characters at most goes to every task.
MOST_CHARACTERS = 200_000


def tagged(words: Column) -> Column:
    """Array of (c, s): each character of the words, in order, with its state."""
    return F.flatten(
        F.transform(
            F.filter(words, lambda w: w != ""),
            lambda w: F.transform(
                F.split(w, ""),
                lambda c, i: F.struct(c.alias("c"), F.when(F.length(w) == 1, "S").when(i == 0, "B").when(i == F.length(w) - 1, "E").otherwise("M").alias("s")),
            ),
        )
    )


def state_counts(texts: DataFrame, words: Column) -> DataFrame:
    """(kind, state, value, n) of texts that are cut into words: kinds start, transition (value: the state that follows) and
    emission (value: the character). One pass, and two shuffles of sums that every task has added up.

    Words are counted first, apart by whether they begin a text and by the length of the word that follows; the characters
    of each distinct word are then tagged once, not at each of its places.
    """
    own = texts.select(F.array_compact(F.array_remove(words, "")).alias("w"))
    following = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0)))
    placed = own.select(F.posexplode(F.arrays_zip(F.col("w").alias("word"), following.alias("next"))).alias("at", "x"))
    found = placed.select("x.word", (F.col("at") == 0).alias("first"), (F.length("x.next") == 1).alias("single"))  # single: null at the end
    counted = found.groupBy("word", "first", "single").agg(F.count(F.lit(1)).alias("n"))
    own = counted.select("first", "single", "n", tagged(F.array("word")).alias("t"))
    row = lambda kind, state, value: F.struct(F.lit(kind).alias("kind"), state.alias("state"), value.alias("value"))
    begun = F.when(F.col("first"), F.get("t", F.lit(0))["s"])
    after = F.when(F.col("single"), "S").when(~F.col("single"), "B")
    start = F.array(row("start", begun, F.lit(None).cast("string")))
    emitted = F.transform("t", lambda x: row("emission", x["s"], x["c"]))
    moved = F.transform("t", lambda x, i: row("transition", x["s"], F.coalesce(F.get("t", i + 1)["s"], after)))
    rows = own.select("n", F.explode(F.concat(start, emitted, moved)).alias("r")).select("r.*", "n")
    return rows.where("state is not null and (kind <> 'transition' or value is not null)").groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(kind, state, value, n, logp): log probabilities with ``alpha`` added to every count that can be.

    An emission without value is that of any character never seen in its state. ``counts``: of ``state_counts``, read
    several times and best a stored table.
    """
    spark = counts.sparkSession
    grid = [("start", s, None) for s in FIRST] + [("transition", s, t) for s in STATES for t in FOLLOWS[s]] + [("emission", s, None) for s in STATES]
    possible = spark.createDataFrame(grid, "kind string, state string, value string")
    own = counts.where("kind <> 'emission' or value is not null")
    rows = own.unionByName(possible.withColumn("n", F.lit(0).cast("long"))).groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("kind", "state").agg(F.sum("n").alias("all"))
    characters = counts.where("kind = 'emission'").agg(F.count_distinct("value").alias("v"))  # one row
    starts = counts.where("kind = 'start'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("begun"))
    joined = rows.join(F.broadcast(sums), ["kind", "state"], "left").crossJoin(F.broadcast(characters)).crossJoin(F.broadcast(starts))
    places = F.when(F.col("kind") == "emission", F.col("v") + 1).otherwise(2)
    total = F.when(F.col("kind") == "start", F.col("begun")).otherwise(F.coalesce("all", F.lit(0)))
    return joined.select("kind", "state", "value", "n", F.ln((F.col("n") + F.lit(alpha)) / (total + F.lit(alpha) * places)).alias("logp"))


class Tagger:
    """The model in a task: the most probable cut of a run of characters."""

    def __init__(self, rows: list[tuple[str, str, str | None, float]]):
        """rows: kind, state, value, logp."""
        self.start, self.moves, self.emits, self.unseen = {}, {}, {}, {}
        for kind, state, value, logp in rows:
            if kind == "start":
                self.start[state] = logp
            elif kind == "transition":
                self.moves[state, value] = logp
            elif value is None:
                self.unseen[state] = logp
            else:
                self.emits.setdefault(value, {})[state] = logp

    def emission(self, state: str, character: str) -> float:
        return self.emits.get(character, self.unseen).get(state, self.unseen[state])

    def states(self, run: str) -> str:
        """The most probable states; of equally probable ones those that come first in ``STATES``, from the end on."""
        score = {s: self.start[s] + self.emission(s, run[0]) if s in FIRST else -math.inf for s in STATES}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            before, score, came = score, {}, {}
            for s in STATES:
                came[s] = max((p for p in STATES if s in FOLLOWS[p]), key=lambda p: before[p] + self.moves[p, s])  # noqa: B023
                score[s] = before[came[s]] + self.moves[came[s], s] + self.emission(s, c)
            back.append(came)
        state = max(LAST, key=score.__getitem__)
        out = [state]
        for came in reversed(back):
            out.append(state := came[state])
        return "".join(reversed(out))

    def cut(self, run: str) -> list[str]:
        if not run:
            return []
        out: list[str] = []
        for c, s in zip(run, self.states(run), strict=True):
            if s in FIRST:
                out.append(c)
            else:
                out[-1] += c
        return out


def tagger(model: DataFrame) -> Tagger:
    """The model of a table (kind, state, value, logp), whose size is checked before it is collected."""
    most = len(STATES) * (MOST_CHARACTERS + 1) + 10
    rows = model.select("kind", "state", "value", "logp").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the model has more than {MOST_CHARACTERS} characters")
    return Tagger([tuple(r) for r in rows])
