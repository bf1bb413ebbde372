"""Passages that decontamination must find wherever their names, numbers and line ends lie."""

from marketloom.llm import decontam

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), DOC)
    items = spark.createDataFrame(list(enumerate(items)), ITEM)
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}


def test_names_at_sentence_starts(spark):
    item = "Tom buys 12 apples for 3 dollars each. Tom sells 5 of them to Ann. How many apples does Tom still have now?"
    short = "Maria walks nine miles along the quiet river today"
    low = "seven boats cross the wide lake, then Peter counts every one of them slowly"
    docs = [
        item.replace("Tom", "Bob").replace("12", "14"),
        f"before it all {item.replace('Tom', 'Bob').replace('Ann', 'Eve')}",
        item.replace(" ", "\n").replace("Tom", "Bob"),
        item.lower(),
        item.upper(),
        f"and so {short}",
        f"He said: {short}",
        f"({short})",
        short.replace("Maria", "Helen").replace(" ", "  "),
        low.replace("seven", "Seven").replace(", then", ". Then").replace("Peter", "Oscar"),
        item.replace("Tom buys", "Bob buys").replace("does Tom", "does Jim").replace("Tom sells", "Sue sells"),
        item.replace("How", "What").replace("Ann", "How"),
        "Nothing of the kind is here, and Tom sells no apples to Ann or to any other of his many friends",
    ]
    got = found(spark, docs, [item, short, low])
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1), (8, 1), (9, 2), (10, 0), (11, 0)}


def test_items_dense_in_numbers_and_short_items(spark):
    sums = "compute 3 + 4 + 5 then 12 17 19 23 29 31 37 41 and give the total of all"
    dense = "take 1 2 3 4 5 6 7 8"
    short = "Name the red planet"
    docs = [f"some words first {sums} and more", f"list: {dense}, done", "please name the red planet", "take 1 2 3 4 5 6 7 9", sums.replace("17", "18"), "the red planet", dense.upper()]
    assert found(spark, docs, [sums, dense, short, "", "7 9 11"]) == {(0, 0), (1, 1), (2, 2), (6, 1)}


def plain_words(text):
    import re

    out = []
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        w = w.translate({ord(c): None for c in decontam.STRIP})
        out += [(w.lower(), w[:1].isupper() and w[1:2].islower())] if w else []
    return out


def by_hand(doc, item, window=8, literal=4, min_run=13):
    """Plain Python over all alignments; no units.  Windows are verbatim, or alike in at least ``literal`` plain words."""
    d, t = plain_words(doc), plain_words(item)
    if len(t) < window:
        return any([w for w, _ in d[i : i + len(t)]] == [w for w, _ in t] for i in range(len(d) - len(t) + 1)) and bool(t)
    for shift in range(-len(t), len(d)):
        ok = {}
        for i in range(len(t) - window + 1):
            pairs = [(t[i + k], d[i + k + shift]) for k in range(window) if 0 <= i + k + shift < len(d)]
            if len(pairs) < window:
                continue
            alike = all(a[0] == b[0] or (a[0].isdigit() and b[0].isdigit()) or (a[1] and b[1]) for a, b in pairs)
            plain = sum(not a[0].isdigit() and not (a[1] and b[1] and a[0] != b[0]) for a, b in pairs)
            ok[i] = alike and plain >= literal or all(a[0] == b[0] for a, b in pairs)
        start = None
        for i in range(len(t) - window + 2):
            if ok.get(i):
                start = i if start is None else start
                continue
            if start is not None:
                run = range(start, i + window - 1)
                maps = {(t[k][0], d[k + shift][0]) for k in run if t[k][0].isdigit() or t[k][1]}
                if len(run) >= min(min_run, len(t)) and len(maps) == len({a for a, _ in maps}):
                    return True
            start = None
    return False


def test_against_plain_python(spark):
    import random

    rng = random.Random(21)
    lows, names = [f"w{c}x" for c in "abcdefghijkl"], ["Tom", "Ann", "Bob", "Eve"]
    make = lambda n: " ".join(rng.choices([rng.choice(lows), rng.choice(names), str(rng.randint(1, 40))], (6, 1, 2), k=1)[0] + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [make(n) for n in (3, 6, 8, 10, 13, 20, 30)]
    swap = dict(zip(names, ["Kim", "Lee", "Max", "Zoe"], strict=True))
    docs = []
    for item in items:
        renamed = " ".join(swap.get(w.strip(".,"), w.strip(".,")) for w in item.split())
        docs += [f"{make(9)} {item} {make(9)}", f"{make(5)}. {renamed}", item.replace(" ", "\n"), item.lower(), make(40), " ".join(item.split()[:7])]
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if by_hand(d, t)}
    assert len(want) >= 20 and found(spark, docs, items) == want
