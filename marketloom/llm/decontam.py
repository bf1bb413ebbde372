"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, number-unit words, units after a number, and names (a capitalised word) turn into
typed placeholders; other words are lower-cased and lose punctuation.  A capitalised word may be a name or not, so an
item's window stands for every choice among its own, and a document's window is looked up with all of them as names,
with those inside a sentence as names, and with none (nor units).  Windows of ``window`` template words, ``literal``
of which at least are plain words, are hashed and joined with the benchmark's windows.  Windows with fewer plain words
join on the words as they are, numbers too, so only verbatim; so do whole items shorter than ``window``.

A window of the benchmark has two anchors, its longest plain words.  A document's words join the first ones and are
kept where the second stands in its place; only the windows placed by such a pair are cut and hashed.  Each form of a
document's window that equals the benchmark's has these words there, so no match is lost.  Tables of the benchmark are
broadcast while they are small; beyond that the joins shuffle.

Hits on one alignment merge into runs.  A run counts if it covers ``min_run`` words or the whole item, and if its
slots are consistent: an item's value always stands for the same value of the document.  So a question with other
numbers or names is found, and a text that merely has the same shape with values at odds is not.

Defined cases: null texts have no words; items without words match nothing; rows that share an id keep
apart by their text; repeated rows of documents give one result row, with the id; repeated items count as one item
each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, drop, save, text_key

# Unit words that become a placeholder after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "degrees", "dollars", "euros", "cents", "inches", "feet", "miles", "pounds", "kwh", "mph", "kmh", "usd", "eur")
STRIP = ".,;:!?\"'()[]{}<>#$%&*+-/=@\\^_`|~«»“”‘’…–—¿¡€£"
PUNCT = r"[!-/:-@\[-`{-~«»“”‘’…–—¿¡€£]"
#: A capitalised word inside a sentence, a unit after a number, any other capitalised word.
NAME, UNIT, START = "\u0002", "\u0003", "\u0004"
#: Stands for a null id inside the operator.
NO_ID = -(2**63)
SLOTS = ("\u0001n", "\u0001q", "\u0001u", "\u0001p")


def marked(text: Column) -> Column:
    """Words with capitals and units marked, lower-cased, without punctuation, joined by spaces.

    The patterns begin with what is rare (a control character, two spaces) or cheap to refuse (a space), and the text
    with a space, so that most characters cost one comparison.
    """
    text = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "[\u0001-\u0004\t-\r][\u0001-\u0004\t-\r ]*| [\u0001-\u0004\t-\r ]+", " ")
    text = F.regexp_replace(text, r" (?<=[\p{L}\p{N},;:] )(\p{Lu})(?=\p{Ll})", f" {NAME}$1")
    text = F.regexp_replace(text, rf" ({PUNCT}*+)(\p{{Lu}})(?=\p{{Ll}})", f" $1{START}$2")
    text = F.lower(text)
    text = F.regexp_replace(text, rf" (?<=\d )((?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", f" {UNIT}$1")
    return F.translate(text, STRIP, "")


def words(text: Column) -> Column:
    """Marked words; an empty array for a text without any."""
    return F.array_remove(F.split(marked(text), " "), "")


def bare(word: Column) -> Column:
    """A marked word without its mark."""
    return F.when(word < "\u0005", word.substr(2, 1 << 30)).otherwise(word)


def template(word: Column, marks: str = NAME + UNIT + START) -> Column:
    """The placeholder of a number or of a word with one of ``marks``, or the word."""
    # a marker or a digit sorts below ':', so most words pay one comparison
    slot = F.when(word.rlike(r"^\d+$"), F.lit(SLOTS[0])).when(word.rlike(rf"^\d+(?:{'|'.join(UNITS)})$"), F.lit(SLOTS[1]))
    for mark in marks:
        slot = slot.when(word.startswith(mark), F.lit(SLOTS[2] if mark == UNIT else SLOTS[3]))
    return F.when(word < ":", slot.otherwise(bare(word))).otherwise(word)


def is_slot(word: Column) -> Column:
    return word.startswith("\u0001")


def _hash(array: Column, size: int) -> Column:
    """Hash of the ``size`` words of an array."""
    return F.xxhash64(*[F.xxhash64(F.get(array, F.lit(k))) for k in range(size)])


def _whole(array: Column) -> Column:
    """Hash of all words of an array."""
    return F.xxhash64(F.array_join(array, " "))


def _anchored(rows: DataFrame) -> DataFrame:
    """Adds a, k, d, b, len: hash and place of the longest literal of ``tmpl``, distance and hash of the next longest
    (itself where there is no other), and the number of words."""
    named = F.transform("tmpl", lambda w, i: F.struct((-F.length(w)).alias("n"), w.alias("w"), i.alias("i")))
    best = F.slice(F.array_sort(F.filter(named, lambda x: ~is_slot(x["w"]))), 1, 2)
    rows = rows.withColumn("__a", best)
    first, second = F.get("__a", F.lit(0)), F.coalesce(F.get("__a", F.lit(1)), F.get("__a", F.lit(0)))
    return rows.withColumns({"a": F.xxhash64(first["w"]), "k": first["i"], "d": second["i"] - first["i"], "b": F.xxhash64(second["w"]), "len": F.size("tmpl")}).drop("__a")


def _item_windows(items: DataFrame, size: int, literal: int) -> DataFrame:
    """item_key, ipos, wh and anchors: the windows of items, for every choice of names among their capitalised words,
    and whole items of fewer words."""
    count = F.size("item_words") - size + 1
    cut = items.filter(count > 0).select("item_key", "item_words", F.explode(F.sequence(F.lit(0), count - 1)).alias("ipos"))
    cut = cut.select("item_key", "ipos", F.slice("item_words", F.col("ipos") + 1, size).alias("ws"))
    word = lambda k: F.get("ws", F.lit(k))
    capital = lambda k: word(k).startswith(NAME) | word(k).startswith(START)
    fixed = sum((F.when(capital(k), 0).otherwise(1 << k) for k in range(size)), F.lit(0)).alias("fixed")
    named = cut.select("*", fixed).select("item_key", "ipos", "ws", F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << size) - 1)), lambda m: m.bitwiseAND(F.col("fixed")) == 0)).alias("mask"))
    chosen = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(SLOTS[3])).otherwise(template(word(k), UNIT)) for k in range(size)]
    named = named.select("item_key", "ipos", F.array(*chosen).alias("tmpl"))
    every = named.union(cut.select("item_key", "ipos", F.transform("ws", lambda w: template(w, "")).alias("tmpl")))
    every = every.filter(F.size(F.filter("tmpl", lambda w: ~is_slot(w))) >= literal)
    few = F.size(F.filter("ws", lambda w: ~is_slot(template(w, "")))) < literal
    every = every.union(cut.filter(few).select("item_key", "ipos", F.transform("ws", lambda w: bare(w)).alias("tmpl")))
    every = _anchored(every).withColumn("wh", _hash(F.col("tmpl"), size))
    short = _anchored(items.filter(count <= 0).select("item_key", F.lit(0).alias("ipos"), F.transform("item_words", lambda w: bare(w)).alias("tmpl"))).withColumn("wh", _whole(F.col("tmpl")))
    return every.unionByName(short).select("item_key", "ipos", "wh", "a", "k", "d", "b", "len").distinct()


def _windows(rows: DataFrame, anchors: DataFrame, size: int, literal: int) -> DataFrame:
    """The columns of ``rows`` but text, with pos, len and wh of each window that holds a pair of anchors: capitals as
    names (not strict), inside sentences, or none; or as they are, where plain words are few or the window is short."""
    keys = [c for c in rows.columns if c != "text"]
    each = rows.select(*keys, words(F.col("text")).alias("ws")).select(*keys, "ws", F.posexplode_outer("ws").alias("at", "word"))  # outer: no filter that would cut the words once more
    start = F.col("at") - F.col("k")
    pair = (F.xxhash64(bare(F.col("word"))) == F.col("a")) & (start >= 0) & (start + F.col("len") <= F.size("ws")) & (F.xxhash64(bare(F.get("ws", F.col("at") + F.col("d")))) == F.col("b"))
    found = each.join(checked(anchors), pair).select(*keys, start.alias("pos"), "len", F.slice("ws", start + 1, F.col("len")).alias("win"))
    form = lambda marks: _hash(F.transform("win", lambda w: template(w, marks)), size)
    few = F.size(F.filter("win", lambda w: ~is_slot(template(w, "")))) < literal
    raw = F.transform("win", lambda w: bare(w))
    one = lambda wh, strict: F.struct(wh.alias("wh"), F.lit(strict).alias("strict"))
    forms = F.array(one(form(NAME + UNIT + START), False), one(form(NAME + UNIT), True), one(form(""), True), one(F.when(few, _hash(raw, size)), True))
    forms = F.when(F.col("len") == size, forms).otherwise(F.array(one(_whole(raw), True)))
    return found.select(*keys, "pos", "len", F.explode(forms).alias("f")).select(*keys, "pos", "len", "f.wh", "f.strict")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 4, min_run: int = 13) -> DataFrame:
    """Matches (doc_id, tkey, item_id, run_words, n_slots, changed): the longest consistent run of each pair."""
    if not 1 <= literal <= window:
        raise ValueError("literal must be from 1 to window: a window's anchors are plain words")
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    items = benchmark.select("item_id", F.col("text").alias("text")).withColumn("item_words", words(F.col("text")))
    items = save(items.select("item_id", "item_words", F.transform("item_words", lambda w: template(w)).alias("item_tmpl")).filter(F.size("item_words") > 0).withColumn("item_key", F.xxhash64("item_id", "item_words")).dropDuplicates(["item_key"]), "items")
    bench = save(_item_windows(items, window, literal), "bench")
    anchors = save(bench.select("a", "k", "d", "b", "len").distinct(), "anchors")
    known = save(bench.select("item_key", "ipos", "wh", "len").distinct(), "known")
    found_at = save(_windows(own, anchors, window, literal).join(checked(known), ["wh", "len"]).select("doc_id", "tkey", "item_key", "pos", "ipos", "len", "strict"), "hits")
    short = found_at.filter(F.col("len") < window).groupBy("doc_id", "tkey", "item_key").agg(F.min("pos").alias("pos"), F.min("len").alias("run_words"))
    # runs of strict hits count beside those of all, whose sentence starts may be at odds
    hits = found_at.filter(F.col("len") == window).select("doc_id", "tkey", "item_key", "pos", "ipos", F.explode(F.when(F.col("strict"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("strict")).distinct()
    diagonal = Window.partitionBy("doc_id", "tkey", "item_key", "strict", "shift").orderBy("pos")
    runs = hits.withColumn("shift", F.col("pos") - F.col("ipos")).withColumn("island", F.col("pos") - F.row_number().over(diagonal))
    runs = runs.groupBy("doc_id", "tkey", "item_key", "strict", "shift", "island").agg(F.min("pos").alias("pos"), F.min("ipos").alias("ipos"), (F.count("*") + window - 1).cast("int").alias("run_words"))
    runs = runs.unionByName(short.select("*", F.lit(0).alias("ipos"), F.lit(False).alias("strict"), F.col("pos").alias("shift"), F.lit(0).alias("island")))
    runs = save(runs, "runs")
    hit_docs = save(runs.select("doc_id", "tkey").distinct(), "hit_docs")
    texts = own.join(checked(hit_docs), ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])
    texts = texts.select("doc_id", "tkey", words(F.col("text")).alias("doc_words"))
    both = runs.join(texts, ["doc_id", "tkey"]).join(checked(items), "item_key").filter(F.col("run_words") >= F.least(F.lit(min_run), F.size("item_words")))
    places = F.filter(F.sequence(F.lit(0), F.col("run_words") - 1), lambda k: is_slot(F.get("item_tmpl", F.col("ipos") + k)) & ~(F.col("strict") & F.get("item_words", F.col("ipos") + k).startswith(START) & (bare(F.get("item_words", F.col("ipos") + k)) == bare(F.get("doc_words", F.col("pos") + k)))))
    pair = F.array_distinct(F.transform(places, lambda k: F.struct(bare(F.get("item_words", F.col("ipos") + k)).alias("a"), bare(F.get("doc_words", F.col("pos") + k)).alias("b"))))
    both = both.withColumn("slots", pair)
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    changed = F.size(F.filter("slots", lambda s: s["a"] != s["b"]))
    found = both.filter(consistent).select("doc_id", "tkey", "item_id", "run_words", F.size("slots").alias("n_slots"), changed.alias("changed"))
    best = F.max_by(F.struct("n_slots", "changed"), F.struct("run_words", -F.col("changed"))).alias("b")
    out = found.groupBy("doc_id", "tkey", "item_id").agg(F.max("run_words").alias("run_words"), best).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "tkey", "item_id", "run_words", "b.n_slots", "b.changed")
    out = save(out, "contaminated")
    drop(items, bench, anchors, known, found_at, runs, hit_docs)
    return out
