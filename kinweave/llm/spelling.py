"""Spelling variants: words that differ by one code point, found by a rare-first prefix filter over positional bigrams.

Every word is the list of its bigrams with their positions. Bigrams are put in one global order, the rarest first (ties: by the bigram, then by
position), and only the ``PREFIX`` first ones of each word are joined. One edit touches at most two bigrams of either word. So of the bigrams
that both words keep, the first one in the order has at most two before it in each word: it is among the first three of both, whatever the words
are. It may have moved by one place only, so a join meets words by bigram, length and position: words of one length at the
same position, and a word with the ones that are one longer at its position or the next. The edit lies on one side of that bigram, in one half of the side; what is outside of the half is
equal, and part of the join's key, or frequent bigrams would meet too many words. What meets is verified by the edit distance.

The order has to be one of bigrams, not of bigrams with positions: it must stay the same when a bigram moves by one place.

Runs, words and counts are built-in expressions; counts are aggregated before the shuffle. The bigrams' frequencies are a table of at most
90 * 90 rows (the word rule's letters), so they are broadcast; words, their keys and pairs never are, whatever size they are judged to have. Forms are followed by doubling, without gathering anything.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty one; repeated rows count each; a run is read whole whatever its length; words of equal
count are variants without a form; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import flattened
from kinweave.storage import shuffled, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
#: One run in so many loses a code point.
NOISE = 199
#: A form is at least so many times as frequent.
RATIO = 5
#: Two bigrams for the edit, and one more.
PREFIX = 3


def spelled(low: str = "low", doc_id: str = "doc_id") -> Column:
    """The lowered run without the code point that its checksum deletes."""
    checksum = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(low)).cast("binary"))
    place = (checksum % F.length(low)).cast("int")
    return F.when(checksum % NOISE == 0, F.concat(F.substring(F.col(low), F.lit(1), place), F.substring(F.col(low), place + 2, F.length(low)))).otherwise(F.col(low))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``MIN_LENGTH`` code points with ``MIN_COUNT`` occurrences. Shorter runs can't become longer words, so they aren't read."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{MIN_LENGTH},}})"), F.lit(1)))
    runs = docs.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("low"))
    return runs.select(spelled().alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def prefixes(vocabulary: DataFrame) -> DataFrame:
    """(word, size, gram, pos): the ``PREFIX`` rarest bigrams of each word."""
    place = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    grams = vocabulary.select("word", place.alias("pos")).select("word", "pos", F.substring("word", F.col("pos"), F.lit(2)).alias("gram"))
    order = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("freq")))
    ranked = grams.join(order, "gram").groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("freq", "gram", "pos"))), 1, PREFIX).alias("rarest"))
    return ranked.select("word", F.length("word").alias("size"), F.explode("rarest").alias("g")).select("word", "size", "g.gram", "g.pos")


def keys(rare: DataFrame, longer: bool) -> DataFrame:
    """(word, key): what a near word has to share with each of a word's bigrams, as a hash.

    The edit lies on one side of an equal bigram, and in one half of that side. All the rest of the word is equal: a key for each of the four
    places. ``longer``: as the longer one of two words whose lengths differ, its side is cut as that of the shorter one.
    """
    more = int(longer)
    size, pos = F.col("size"), F.col("pos")
    # the other word's part before the bigram, and its part after it
    before, after = pos - 1, size - pos - 1
    halves = [F.floor((n - more) / 2).cast("int") for n in (before, after)]

    def key(kind: int, side: Column, at: Column, length: Column) -> Column:
        """The word without ``length`` code points from ``at`` on (from 0)."""
        rest = F.concat(F.substring(F.col("word"), F.lit(1), at), F.lit(" "), F.substring(F.col("word"), at + length + 1, size))
        # the bigram's place in the shorter word
        place = pos - more if kind < 2 else pos
        return F.when(side >= more, F.xxhash64(F.lit(kind), size - more, place, rest))

    places = [
        key(0, before, F.lit(0), halves[0] + more),
        key(1, before, halves[0], before - halves[0]),
        key(2, after, pos + 1, halves[1] + more),
        key(3, after, pos + 1 + halves[1], after - halves[1]),
    ]
    return rare.select("word", "size", F.explode(F.array(*places)).alias("key")).where("key IS NOT NULL")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, other): each pair of near words, both ways."""
    rare = stored(prefixes(vocabulary), "prefixes")
    own = keys(rare, False)
    a, b, longer = own.select("word", "key", "size"), own.select(F.col("word").alias("other"), "key", "size"), keys(rare, True).select(F.col("word").alias("other"), "key")
    equal = a.join(shuffled(b), ["key", "size"]).where("word < other").select("word", "other")
    pairs = equal.unionByName(a.join(shuffled(longer), "key").select("word", "other"))
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1).distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    vocabulary = stored(words(docs), "words")
    counted = near_pairs(vocabulary).join(shuffled(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))), "other")
    first = F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other").alias("word")))
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    joined = vocabulary.join(shuffled(best), "word", "left")
    good = -F.col("best.minus_n") >= RATIO * F.col("n")
    joined = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.minus_n")).alias("form_n")), "forms"
    )
    roots = flattened(joined.select(F.col("word").alias("node"), F.coalesce("form", "word").alias("label")))
    return joined.join(shuffled(roots.select(F.col("node").alias("word"), F.col("label").alias("root"))), "word")


def grouped(docs: DataFrame) -> DataFrame:
    """(root, word, n): every word with the last form of its group; the largest n is the root's own."""
    return variants(docs).select("root", "word", "n")


def report(docs: DataFrame) -> DataFrame:
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
