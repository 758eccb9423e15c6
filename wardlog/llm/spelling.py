"""Spelling variants: words one edit apart, found by a frontier over a relational trie.

The trie is a table of edges (node, child, letters, word), held in partitions. A node is
a prefix that at least two different letters follow, or at which a word ends; an edge
carries the letters up to the next node, so that long words take few levels. ``word``
names the word that ends at the child. States (word, position, node, edits) are joined
with the edges of their node level by level; an edge is walked with at most one edit
(a letter replaced, or a letter of the state's word left out). A state whose letters are
used up at the end of another word makes the two words neighbours.

A pair one edit apart has half of its longer word in common at the start or at the end.
So there are two tries, one of the words and one of the reversed words, and a state
starts below half of its word. Prefixes above the first half of their word are not in
the trie, so its upper, crowded part does not exist. The longer word of a pair finds the
shorter one, so states add no letters.

Nodes are named by a 64-bit hash of their prefix. Two prefixes that share one only add
edges; the neighbours found are compared letter by letter.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import GOLDEN, mix, text_slices
from wardlog.session import stored

LEAST_LENGTH, LEAST_COUNT, MUCH_MORE, STEP = 7, 2, 10, 31
SLICE = 8 << 20


def count_runs(doc_id: int | None, text: str, pattern: re.Pattern, least: int, step: int, counts: Counter) -> None:
    """Adds the words of one text to ``counts``, one letter gone from those whose hash ``step`` divides."""
    import zlib

    lead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # bytes.lower changes A to Z only
    for low, n in Counter(pattern.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(low.encode(), lead)
        if h % step == 0:
            at = h % len(low)
            low = low[:at] + low[at + 1 :]
        if len(low) >= least:
            counts[low] += n


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_length`` letters and ``least_count`` occurrences."""
    # longest runs, as a shorter run cannot hold a word
    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def run(batches):
        for part in text_slices(batches, SLICE):
            counts: Counter = Counter()
            for doc_id, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                count_runs(doc_id, text or "", pattern, least_length, step, counts)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


def half(size):
    """Letters that a word of ``size`` letters surely shares with a neighbour no longer than it, at one of its ends."""
    return size // 2


PREFIXES = "backward boolean, word string, node bigint, depth int, letter int, second int, last boolean"


def prefixes(words: DataFrame) -> DataFrame:
    """(backward, word, node, depth, letter, second, last): the prefixes from half of each word on, both ways.

    ``letter`` and ``second`` follow the prefix, 0 behind the end of the word.
    """

    def rows(found: list[str], backward: bool) -> list[pa.Array]:
        texts = [w[::-1] for w in found] if backward else found
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in found])
        ends = np.cumsum(size)
        place = np.arange(len(points)) - np.repeat(ends - size, size)
        # a prefix's hash is the sum of hashes of its letters and their places
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) * GOLDEN + place.astype(np.uint64)))])
        start = half(size)
        count = size - start + 1
        owner = np.repeat(np.arange(len(found)), count)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        begin = (ends - size)[owner]
        node = mix(total[begin + depth] - total[begin] + depth.astype(np.uint64)).view(np.int64)
        last = depth == size[owner]
        ahead, room = np.append(points, np.zeros(2, np.uint32)), size[owner] - depth
        letter = np.where(last, 0, ahead[begin + depth]).astype(np.int32)
        second = np.where(room < 2, 0, ahead[begin + depth + 1]).astype(np.int32)
        names = pa.array(found, pa.string()).take(pa.array(owner))
        return [pa.array(np.full(len(owner), backward)), names, pa.array(node), pa.array(depth.astype(np.int32)), pa.array(letter), pa.array(second), pa.array(last)]

    def run(batches):
        for batch in batches:
            for part in text_slices([batch], 256 << 10, "word"):
                found = part["word"].to_pylist()
                if found:
                    for backward in (False, True):
                        yield pa.RecordBatch.from_arrays(rows(found, backward), ["backward", "word", "node", "depth", "letter", "second", "last"])

    return words.select("word").mapInArrow(run, PREFIXES)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (backward, node, child, letters, word, next, pairs) and the states that words start with.

    ``text`` is the word, turned round if ``backward``; ``ends`` names the word that ends
    at the state's node; ``next`` and ``pairs`` have the bits of what follows the child.
    """
    rows = stored(prefixes(words), "prefixes")
    facts = rows.groupBy("backward", "node").agg(
        (F.min("letter") < F.max("letter")).alias("forks"),
        *[F.bit_or(F.when(F.col("last"), 0).otherwise(bit)).alias(n) for n, bit in letter_bits(F.col("letter"), F.col("second")).items()],
    )
    # at most one word ends at a node, but for equal hashes
    ends = rows.where("last").select("backward", "node", F.col("word").alias("ends"))
    forks = stored(facts.where("forks").drop("forks").join(ends, ["backward", "node"], "left"), "forks")
    kept = rows.join(forks.select("backward", "node", F.lit(True).alias("fork"), "ends", "next", "pairs"), ["backward", "node"], "left")
    kept = kept.where(F.col("fork") | F.col("last"))
    # the nodes on the way of one word, at most one a letter
    ways = kept.groupBy("backward", "word").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "fork", "ends", "next", "pairs"))).alias("way"))
    ways = stored(ways.where(F.col("way")[0]["fork"]).withColumn("text", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))), "ways")
    steps = ways.where(F.size("way") > 1).select("*", F.explode(F.sequence(F.lit(1), F.size("way") - 1)).alias("i"))
    begin, end = F.col("way")[F.col("i") - 1], F.col("way")[F.col("i")]
    steps = steps.select(
        "backward",
        begin["node"].alias("node"),
        end["node"].alias("child"),
        F.substring("text", begin["depth"] + 1, end["depth"] - begin["depth"]).alias("letters"),
        F.coalesce(end["ends"], F.when(F.col("i") == F.size("way") - 1, F.col("word"))).alias("word"),
        *[F.coalesce(end[c], F.lit(0)).alias(c) for c in ("next", "pairs")],
    )
    edges = steps.where("letters != ''").distinct()
    first = F.col("way")[0]
    starts = ways.select(
        "backward", "text", first["depth"].alias("position"), first["node"].alias("node"), F.lit(0).alias("edits"), first["ends"].alias("ends")
    )
    return stored(edges, "edges"), starts


def letter_bits(letter: Column, second: Column) -> dict[str, Column]:
    """One of 63 bits for the letter and one for it and the letter after it.

    A node has the bits of all that follows it; letters whose bit it lacks do not.
    """
    bit = lambda code: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(code, F.lit(63)).cast("int"))
    return {"next": bit(letter), "pairs": bit(letter * 31 + second)}


def advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level further; ``ends`` names the word that ends at their node.

    Of the letters ahead as many as the edge has are the same, or one of them is replaced,
    or one more is left out. A state goes on if it can: its next letter follows the node.
    """
    size, at = F.length("letters"), F.col("position") + 1
    head = F.substring("letters", F.lit(1), F.lit(1))
    ahead = F.substring("text", at, F.lit(1))
    edges = edges.withColumn("head", head)
    # the same letters: one edge of a node at most, but for equal hashes
    same = states.drop("ends").withColumn("head", ahead).join(edges, ["backward", "node", "head"]).where(F.substring("text", at, size) == F.col("letters"))
    same = same.select("backward", "text", (F.col("position") + size).alias("position"), F.col("child").alias("node"), "edits", F.col("word").alias("ends"), "next", "pairs")
    # an edit: any edge of the node
    met = states.where("edits = 0").drop("ends").join(edges, ["backward", "node"])
    later, one_letter, differs = F.substring("letters", F.lit(2), size), size == 1, ahead != F.col("head")
    near = lambda n: (F.length(n) > 0) & (F.levenshtein(n, "letters", 1) == 1)
    as_long, longer = F.substring("text", at, size), F.substring("text", at, size + 1)
    replaced = F.when(differs, F.substring("text", at + 1, size - 1) == later).when(one_letter, False).otherwise((F.length(as_long) == size) & near(as_long))
    left_out = F.when(differs, F.substring("text", at + 1, size) == F.col("letters")).when(one_letter, False).otherwise((F.length(longer) == size + 1) & near(longer))
    moves = F.array_compact(F.array(F.when(replaced & (F.col("position") + size <= F.length("text")), size), F.when(left_out, size + 1)))
    met = met.select("backward", "text", "position", "child", "word", "next", "pairs", F.explode(moves).alias("far"))
    met = met.select("backward", "text", (F.col("position") + F.col("far")).alias("position"), F.col("child").alias("node"), F.lit(1).alias("edits"), F.col("word").alias("ends"), "next", "pairs")
    gone = same.unionAll(met)
    rest = F.length("text") - F.col("position")
    letter = lambda n: F.ascii(F.substring("text", F.col("position") + n, F.lit(1)))
    follows = F.lit(True)
    for c, bit in letter_bits(letter(1), letter(2)).items():
        follows = follows & (F.col(c).bitwiseAND(bit) != 0)
    alive = F.when(rest == 0, F.col("ends").isNotNull() & (F.col("edits") == 1)).otherwise((F.col("edits") == 0) | follows)
    gone = gone.where(alive).drop("next", "pairs")
    return gone.withColumn("ends", F.when(F.col("edits") + F.length("text") - F.col("position") == 1, F.col("ends")))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point; ``a`` is no shorter."""
    return (F.length(a) - F.length(b) <= 1) & (F.levenshtein(a, b, 1) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of different words one edit apart."""
    edges, starts = trie(words)
    states = stored(starts, "frontier")
    found = None
    rest, word = F.length("text") - F.col("position"), F.when(F.col("backward"), F.reverse("text")).otherwise(F.col("text"))
    while True:
        # a letter left over at the end of another word is left out
        met = states.where(F.col("ends").isNotNull() & (F.col("edits") + rest == 1)).select(word.alias("word"), F.col("ends").alias("near"))
        found = met if found is None else found.unionAll(met)
        states = stored(advance(states.where(rest > 0), edges), "frontier")
        if states.isEmpty():
            break
    found = found.where("word != near").where(one_edit(F.col("word"), F.col("near")))
    both = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))
    return found.select(both.alias("p")).select("p.word", "p.near").distinct()


def variants(words: DataFrame, much_more: int = MUCH_MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each row of ``words`` (word, n).

    ``form`` is the near word of largest n (the smallest word among equals) if that is
    at least ``much_more`` times the word's own, else null; ``root`` is where forms lead.
    """
    words = stored(words, "counted")
    pairs = neighbours(words)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    best_n = -F.col("best")["order"]
    fits = best_n >= much_more * F.col("n")
    rows = stored(
        rows.select(
            "word", F.when(fits, F.col("best")["near"]).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, best_n).alias("form_n"),
        ),
        "forms",
    )
    # forms grow at least tenfold, so a few doublings of the way reach the end
    ways = stored(rows.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "ways")
        if moved.where("further is not null").isEmpty():
            break
        ways = moved.drop("further")
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, much_more: int = MUCH_MORE,
    step: int = STEP, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``.

    Null and empty texts have no words; a null id counts as an empty one where runs are
    hashed; repeated rows each count; words without near words have ``n_near`` 0 and are
    their own root. Other columns are not read. An empty table gives no rows.
    """
    return variants(word_counts(docs, least_length, least_count, step, id_col, text_col), much_more)
