"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from other_pages import OtherPages
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, html_extraction, html_training, language_id, licenses, media, packing, quality, secrets, simhash, token_counts

D = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key0 int, fp string, text_x string"
LONG = "word " * 40_000


def docs(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], "s", None, 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


ODD = [None, "", " ", "\n", "x", "same text here", "same text here", "ünï 中文 😀", "a\x00b", LONG, "1234567890123456", "<p>&amp;", "🙂" * 300]
PIPE = [None, "", "same text here", "same text here", LONG]


def by_id(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def rows(sample):
    return sample.orderBy("doc_id").collect()


# every operator: empty tables, null and repeated ids, clashing columns

PER_ROW = {
    "licenses": licenses.scan_licenses,
    "secrets": secrets.scan_secrets,
    "simhash": lambda d: simhash.near_duplicates(d),
    "token_counts": lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    "media": media.store_media,
    "quality": lambda d: quality.score_quality(d, d.sparkSession.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(spark, name):
    """Rows without an id or with one that repeats stay; columns of other names don't matter; no rows give none."""
    texts = ["some words here", "some words here", None, "", "others"]
    got = PER_ROW[name](docs(spark, texts, ids=[None, None, 7, 7, None])).collect()
    assert len(got) == 5 and sorted(r["doc_id"] is None for r in got) == [False, False, True, True, True]
    assert PER_ROW[name](docs(spark, [])).count() == 0


def test_html_rows(spark, trees):
    rows = [(None, "u", "<p>a b c</p>", 1), (None, "u", "<p>a b c</p>", 1), (3, None, None, 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extraction.extract_text(table, trees).collect()
    assert len(got) == 3 and len({r["text"] for r in got if r["page_id"] is None}) == 1
    assert html_extraction.extract_text(table.limit(0), trees).count() == 0


# 1 language ID


def test_language_held_out(spark, sample):
    got = language_id.identify(sample, language_id.learn(sample)).join(sample.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_odd(spark, sample):
    model = language_id.learn(sample)
    got = by_id(language_id.identify(docs(spark, ODD), model), "lang_pred", "score")
    assert got[0] == got[1] == got[2] == got[10] == ("und", 0.0) and got[5] == got[6] and all(0 <= s <= 1 for _, s in got)
    none = language_id.identify(docs(spark, ["abc"], [None]), language_id.learn(docs(spark, ["abc"], [None])))
    assert none.first()["lang_pred"] == "und"
    assert language_id.identify(docs(spark, []), model).count() == 0


def test_language_mixture_is_likeliest():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(40), 2).T
    n = rng.multinomial(5000, 0.7 * p[:, 0] + 0.3 * p[:, 1]).astype(float)
    share, value = language_id.fit(p, n, 200)
    grid = max((float(n @ np.log(p @ np.array([a, 1 - a]))), a) for a in np.linspace(0.01, 0.99, 99))
    assert share[0] == pytest.approx(grid[1], abs=0.02) and value >= grid[0] - 1e-3


# 2 decontamination

ITEM = "A farmer sold 40 sheep to Mister Brown for 300 dollars and then bought 40 goats with the money he had left over"


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny"), (3, None), (4, "only seven words stand in here now")], "item_id long, text string")
    texts = [
        "Before it. " + ITEM + " after it.",
        "Before. " + ITEM.replace("40", "75").replace("300", "9000").replace("Brown", "Green"),
        "Before. " + ITEM.replace("40 goats", "41 goats").replace("40 sheep", "7 sheep").replace("300", "41").replace("Brown", "Green"),
        "nothing of the kind is said in this text about anyone at all or anything",
        "we say only seven words stand in here now too",
        None, "", ITEM.upper(),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["exact"], r["consistency"]) for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    assert (0, 1) in got and got[0, 1] == (True, 1.0)
    assert got[1, 1][0] is False and got[1, 1][1] == 1.0
    assert (4, 4) in got and (7, 1) in got and not any(d in (3, 5, 6) for d, _ in got)
    clean = decontamination.without_leaks(docs(spark, texts), bench)
    assert clean.columns == docs(spark, []).columns and {r["doc_id"] for r in clean.collect()}.isdisjoint({0, 1, 4, 7}) and clean.where("doc_id = 3").count() == 1


def test_leaks_of_items_dense_in_slots(spark):
    items = ["What is 12 plus 7?", "Compute 12 + 7 - 3 * 4.", "add 1 2 3 4 5 6 7 8 9 10"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [*(f"before it {t} and after it" for t in items), "before it What is 13 plus 7? and after it", "add 1 2 3 4 5 6 7 8 and 9 10"]
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    assert got == {(0, 0, True), (1, 1, True), (2, 2, True)}


def test_leaks_of_names_that_begin_sentences(spark):
    item = "Anna has 3 red apples. Anna buys 4 more. How many has Anna now?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("Anna", "Ben"), "he said that Anna has 3 red apples. Anna buys 4 more. How many has Anna now?", item.replace("Anna", "Ben", 1).replace("has Anna", "has Carl"), "so anna has red apples"]
    got = {r["doc_id"]: r["exact"] for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    assert got == {0: False, 1: True}


def test_leaks_by_the_best_place(spark):
    """A look-alike with inconsistent values, before or after the question, doesn't hide it."""
    item = "a farmer sold 40 sheep and 40 goats for 40 coins, kept 40 hens, lost 40 ducks and bought 40 geese at the fair"
    other = re.sub("40", lambda m: str(m.start() + 7), item)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    gap = " and here are other words of no use to anyone " * 3
    texts = [f"{other}. {gap} {item}.", f"{item}. {gap} {other}.", f"{other} {item}", f"{other}. {gap} {other}.", f"{other}. " * 30 + item]
    got = {r["doc_id"]: r["exact"] for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    assert got == {0: True, 1: True, 2: True, 4: True}


def test_leaks_of_rows_without_an_id(spark):
    """Fragments of an item in several rows aren't one document, whatever their ids."""
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM), (1, ITEM)], "item_id long, text string")
    words = ITEM.split()
    parts = [" ".join(words[i : i + 12]) for i in (0, 6, 12)]
    for ids in ([None] * 3, [5] * 3):
        assert decontamination.find_leaks(docs(spark, parts, ids=ids), bench).count() == 0
    rows = decontamination.find_leaks(docs(spark, [ITEM, ITEM, ITEM + " x"], ids=[None, None, None]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in rows) == [(None, 0), (None, 0), (None, 1), (None, 1)]
    assert decontamination.find_leaks(docs(spark, []), bench).count() == 0
    assert decontamination.find_leaks(docs(spark, [ITEM]), bench.limit(0)).count() == 0
    assert decontamination.without_leaks(docs(spark, [ITEM, None, "x"], ids=[None, None, None]), bench).count() == 2


def naive_leaks(texts, items):
    """Pairs by the definition: every place, distance and reading looked at."""
    d = decontamination
    templates = d.Templates()

    def windows(text, width, verbatim):
        word, _, readings = templates.read([text])
        if verbatim:
            h = templates.hashes[word].tolist()
            return {(i, tuple(h[i : i + width]), ()) for i in range(len(h) - width + 1)}, len(word)
        out = set()
        for h, slot in readings:
            h = h.tolist()
            for i in range(len(h) - width + 1):
                if width - sum(slot[i : i + width]) >= min(d.LITERALS, width):
                    out.add((i, tuple(h[i : i + width]), tuple(templates.words[w].lower() for w, s in zip(word[i : i + width], slot[i : i + width]) if s)))
        return out, len(word)

    found = set()
    for k, item in enumerate(items):
        width = min(d.WIDTH, len(templates.read([item])[0]))
        if width < d.LEAST:
            continue
        own, least = windows(item, width, False)[0], d.SHARE
        if not own:
            own, least = windows(item, width, True)[0], 1.0
        n = len({i for i, *_ in own})
        stretch = max(d.LEAST_STRETCH, n + d.WIDTH)
        for j, text in enumerate(texts):
            places = {}
            for i, h, b in windows(text, width, least == 1.0)[0]:
                for at, g, a in own:
                    if g == h:
                        for place in ((0, i - at), (1, (i - at) // stretch), (2, (i - at + stretch / 2) // stretch)):
                            places.setdefault(place, []).append((at, list(zip(a, b))))
            for hits in places.values():
                slots = {s for _, zipped in hits for s in zipped}
                if len({at for at, _ in hits}) / n >= least and (not slots or len({a for a, _ in slots}) / len(slots) >= d.CONSISTENT):
                    found.add((j, k))
    return found


def test_leaks_like_all_places(spark):
    rnd = random.Random(16)
    names, things = ["Anna", "Ben", "Carl", "Dora"], ["apples", "coins", "books"]
    forms = [
        "{n} has {a} red {t}. {n} buys {b} more {t} at the market. How many {t} has {n} now?",
        "A train leaves at {a} and travels {b} km to the town where {n} waits with {a} bags of {t}.",
        "What is {a} plus {b}?", "{n} and {m} share {a} {t} so that {n} gets {b} and the rest goes to {m} before they walk home together.",
    ]

    def made(form):
        n, m = rnd.sample(names, 2)
        return form.format(n=n, m=m, a=rnd.randint(2, 99), b=rnd.randint(2, 99), t=rnd.choice(things))

    items = [made(rnd.choice(forms)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            w = made(rnd.choice(forms)).split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = [rnd.choice(["very", "Ben", "12", "old", "The"])]
            parts.append(" ".join(w))
        texts.append(" then ".join(parts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs(spark, texts), bench).collect()}
    want = naive_leaks(texts, items)
    assert got == want and 50 < len(want) < len(texts) * len(items)


def test_leaks_brute_force(spark, sample, rows):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    for b in bench.collect():
        w = " ".join(words(b["text"]))
        want |= {(r["doc_id"], b["item_id"]) for r in rows if w and f" {w} " in f" {' '.join(words(r['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(sample, bench).collect()}
    assert got == want


# 3 licences


def naive_statistics(tokens, templates):
    out = []
    for i in range(len(tokens)):
        n = i + 1
        while n and not any(tokens[i + 1 - n : i + 1] == t[k : k + n] for t in templates for k in range(len(t) - n + 1)):
            n -= 1
        out.append(n)
    return out


def test_suffix_automaton_against_naive():
    rnd = random.Random(1)
    for _ in range(60):
        templates = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] for _ in range(3)]
        sam = licenses.SuffixAutomaton()
        for k, t in enumerate(templates):
            sam.add(t, k)
        sam.close()
        tokens = [rnd.randint(0, 4) for _ in range(30)]
        want = naive_statistics(tokens, templates)
        ends = {end: (n, s) for end, n, s in sam.statistics(tokens)}
        for i, n in enumerate(want):
            if n and (i + 1 == len(tokens) or want[i + 1] != n + 1):
                assert ends[i + 1][0] == n
                occurrences = {(k, e) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == tokens[i + 1 - n : i + 1]}
                assert occurrences == set(sam.ends[ends[i + 1][1]])


def test_licences(spark):
    texts = ["x Licensed under CC BY-NC 4.0. All rights reserved", "Released under the MIT License. " * 3, "ccby general  PUBLIC\nlicense", next(t for t in licenses.TEMPLATES["apache-2.0"] if t.startswith("Unless")), *ODD]
    got = by_id(licenses.scan_licenses(docs(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got[0][1:6] == (2, 3, 8, "cc-by,reserved", "cc-by,cc-by-nc,reserved") and got[0][6] == 1.0
    assert got[1][1:6] == (0, None, None, "", "mit") and got[2][1:5] == (1, 1, 1, "gpl") and got[3][5] == "apache-2.0"
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    for t, g in zip(texts, got):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert g[0] == len(word.findall(low)) and 0 <= g[6] <= 1


def label_of(text):
    return licenses._scanner(tuple((k, t) for k, ts in licenses.TEMPLATES.items() for t in ts), tuple(licenses.BASE.items())).scan(text.encode())


def test_licences_are_not_confused():
    """Every template, of every label, gives its own label and no other, in whole and with a few words changed."""
    rnd = random.Random(14)
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = text.split()
            assert set(label_of(f"words before it {text} words after it")[5].split(",")) - {"cc-by", "gpl", "reserved"} == {label}, text
            if len(words) > 40:
                at = rnd.randrange(8, len(words) - 8)
                got = set(label_of(" ".join(words[:at] + ["changed"] + words[at:]))[5].split(",")) - {"cc-by", "gpl", "reserved", ""}
                assert got == {label}, (text, got)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "gpl,gpl-2.0"),
        ("SPDX-License-Identifier: Something-1.0", ""),
        ("Licensed under the Something License", ""),
        ("Licensed under the GNU Lesser General Public License version 3", "gpl"),
        ("this program is free software and you can redistribute it", ""),
    ],
)
def test_licence_notices(text, labels):
    assert label_of(text)[5] == labels


def test_licence_base_places_against_naive():
    rnd = random.Random(15)
    bits = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "Reserved", "x", "-", "\n", "é"]
    for _ in range(300):
        text = " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        want = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = label_of(text)
        assert got[0] == len(words) and got[1] == len(want) and got[4] == ",".join(sorted({label for _, label in want}))
        assert (got[2], got[3]) == ((min(want)[0], max(want)[0]) if want else (None, None))


# 4 secrets


def naive_known(text):
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [("assign", m) for m in re.finditer(rf"({keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 12]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(((m.start(), m.end(), k) for k, m in found), key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets(spark, rows):
    rnd = random.Random(2)
    key = "".join(rnd.choice(secrets.ENCODINGS["base62"]) for _ in range(60))
    texts = ["é API_KEY: 'abcdefgh1234' x", "Token=short", "AKIA" + "A" * 14, "0" * 15 + "g" + "a" * 16, "token = " + "a" * 12 + " " + "f" * 20, f"look {key} here", "passwordſ=abcdefghijklmnop", *ODD, *(r["text"] for r in rows[:120])]
    got = by_id(secrets.scan_secrets(docs(spark, texts)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for t, g in zip(texts, got):
        base = naive_known(t or "")
        n = Counter(k for *_, k in base)
        assert g[:3] == (n["assign"], n["access"], n["hex"])
        assert g[3] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, e, k in base} <= set(g[4].split(","))
    assert "random:5:65" in got[5][4]
    red = by_id(secrets.redact_secrets(docs(spark, texts)), "text")
    assert red[5] == ("look [random] here",) and red[0][0].startswith("é [assign]") and red[7] == (None,)


def test_battery_tells_random_from_text():
    rnd = random.Random(3)
    p = [secrets.battery("".join(rnd.choice(secrets.ENCODINGS["base64"]) for _ in range(60))) for _ in range(50)]
    assert np.median([max(x[1:]) for x in p]) < 1e-8 and max(max(x[1:]) for x in p) < 1e-3
    for text in ("internationalization2024", secrets.ENCODINGS["base62"], "AB" * 20, "aaaabbbbccccddddeeee", "a" * 40, "getElementsByTagNameAndSomething"):
        assert max(secrets.battery(text)[1:]) > 0.1
    assert secrets.discovery({}) == {} and secrets.discovery({(0, 0): 100})[0] == secrets.P_BINS
    for n, k, q in ((19, 9, 0.1), (47, 24, 0.1), (30, 30, 0.05), (30, 0, 0.3)):  # a bound of the exact tail
        exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
        assert exact <= secrets.binomial_tail(n, k, q) * (1 + 1e-9)


PLAIN = (
    "the of in to internationalization misunderstanding documentation-of-things some_long_variable_name_here getElementsByTagNameAndSomething "
    "/usr/local/share/applications/python3 https://www.example.com/articles/the-quick-brown-fox-jumps-over nondeterministically-computed "
    "Donaudampfschifffahrtsgesellschaft abcdefghijklmnopqrstuvwxyz0123456789 ABABABABABABABABABABAB -------------------- aaaaaaaaaaaaaaaaaaaaaaaa"
).split()


def test_secrets_planted_in_their_places(spark):
    """Recall of keys in addresses, headers, settings and paths; discoveries among plain words."""
    rnd = random.Random(8)
    b62, b64 = secrets.ENCODINGS["base62"], secrets.ENCODINGS["base64"]
    key = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    forms = [
        lambda: ("session=", key(b62, 48), ""), lambda: ("https://x.org/a?sig=", key(b64, 48), "&b=1"), lambda: ("key/", key(b62, 29), "-suffix"),
        lambda: ("", key(secrets.ENCODINGS["letters"], 48), ""), lambda: ("Authorization: Bearer ", key(b64, 43), "="), lambda: ("AWS_SECRET_ACCESS_KEY=", key(b64, 40), ""),
        lambda: ("/home/user/", key(b62, 40), "/file"), lambda: ("", key(b62, 4096) + "a" * 24, ""),
    ]
    texts, where = [], []
    for i in range(400):
        before, secret, after = forms[i % len(forms)]()
        head = " ".join(rnd.choices(PLAIN, k=20)) + " " + before
        texts.append(head + secret + after + " " + " ".join(rnd.choices(PLAIN, k=5)))
        where.append((len(head), len(head) + len(secret)))
    found, false = [0] * len(forms), 0
    for i, (spans,) in enumerate(by_id(secrets.scan_secrets(docs(spark, texts)), "spans")):
        lo, hi = where[i]
        spans = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s.startswith("random")]
        found[i % len(forms)] += any(min(e, hi) - max(s, lo) >= 0.9 * (hi - lo) for s, e in spans)
        false += sum(e <= lo or s >= hi for s, e in spans)
    assert min(found) >= 0.9 * 50 and false == 0


def test_secrets_beside_known_shapes():
    """What a known shape leaves of a run is tested."""
    rnd = random.Random(9)
    key = "".join(rnd.choice(secrets.ENCODINGS["base62"].replace("0123456789", "ghijk")) for _ in range(60))
    base, more = secrets.scan(("x " + "0" * 16 + "/" + key + " y").encode())
    assert [s[2] for s in base] == ["hex"] and [(s, e) for s, e, _, p in more if p > 100] in ([(18, 79)], [(19, 79)])


# 5 packing


def test_packing_encodes_many_rows_together(rows):
    """Segments of several batches are encoded once, in few calls; ids are those of whole texts wherever texts begin and end."""
    enc = packing.SegmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["zz", "", None, " ", "a", "a ", "  a", "\n\nb\n\n", "it's 'll", "中文。\u3000x", "a\x0bb", "<|endoftext|> <|endof", "a", " " * 1_500_000 + "word", *(r["text"] for r in rows[:200])]
    whole = [enc.whole(t or "") for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert enc.encode(pa.array(["y", *texts, "y"], kind).slice(1, len(texts))) == whole
    batches = [pa.record_batch({"doc_id": pa.array([i]), "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    ((ids, column),) = packing.chunks(iter(batches))
    assert ids == list(range(len(texts))) and enc.encode(column) == whole
    assert [len(i) for i, _ in packing.chunks(iter([batches[0]] * (packing.CHUNK_ROWS + 1)))] == [packing.CHUNK_ROWS, 1]
    many, seen, fast = texts[14:] * 20, [], enc.fast

    class Counting:
        def encode_ordinary(self, text):
            seen.append(len(text))
            return fast.encode_ordinary(text)

    enc.fast = Counting()
    enc.encode(pa.array(many))
    assert len(seen) == 1 and seen[0] < sum(len(t or "") for t in texts[14:])


def test_packing(spark, sample, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = packing.encoder(path)
    for table, texts in ((docs(spark, PIPE + ["<|endoftext|> a"]), PIPE + ["<|endoftext|> a"]), (sample, [r["text"] for r in rows])):
        ids = [np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
        got = packing.pack(table, path).collect()
        pieces, windows = {}, {}
        for r in got:
            pieces.setdefault(r["doc_id"], []).append(r)
            windows.setdefault(r["sequence_id"], []).append(r)
        for i, want in enumerate(ids):
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want) and zlib.crc32(want[at : at + r["length"]].tobytes()) == r["ids_crc32"]
                at += r["length"]
            assert at == len(want)
        short = 0
        for w in windows.values():
            at = 0
            for r in sorted(w, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
            short += at < 1024
        assert short <= 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_segments_equal_the_library():
    enc = packing.SegmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "é", "😀", "<|endoftext|>", "x" * 30, "中文", "\t", "0", ".", "'s", "'ll", "\x1c", "　", "\r\n", "\xa0"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    want = [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode_all(texts) == want


def test_plan_uses_every_tail_once():
    rnd = random.Random(5)
    counts = {k: rnd.randint(0, 30) for k in range(1, 64)} | {40: 900}
    plan, used = packing.make_plan(counts, 64), {}
    for k, n in counts.items():
        for rank in range(n):
            for _, size, w, off in packing.place(plan, k, rank):
                used.setdefault(w, []).append((off, size))
    total = sum(k * n for k, n in counts.items())
    assert len(used) == plan["windows"] == -(-total // 64)
    for spans in used.values():
        at = 0
        for off, size in sorted(spans):
            assert off == at
            at += size
        assert at <= 64


# 6 SimHash


def naive_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def naive_components(fps, bits=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, rows):
    texts = [*ODD, *(r["text"] for r in rows[:150])]
    got = by_id(simhash.near_duplicates(docs(spark, texts)), "fp", "component_id")
    fps = [naive_fingerprint(t) for t in texts]
    assert [f % (1 << 64) for f, _ in got] == fps and [c for _, c in got] == naive_components(fps)


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("most", [2, 64])
def test_links_connect_like_all_pairs(spark, monkeypatch, bits, most):
    monkeypatch.setattr(simhash, "LIST_MAX", most)
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = list({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(3)) for b in base for _ in range(40)} | {rnd.getrandbits(64) for _ in range(20)})
    signed = [simhash._signed(f) for f in fps]
    scratch = common.Scratch(spark, "test")
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, scratch, bits), scratch).collect()}
    groups = lambda labels: {frozenset(s for s, x in zip(signed, labels) if x == y) for y in labels}
    assert groups([roots.get(s, s) for s in signed]) == groups(naive_components(fps, bits))


def test_one_of_each(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    long_ = [word() for _ in range(300)]
    near = [*long_]
    near[10], near[200] = "other", "another"
    other = [word() for _ in range(300)]
    half = long_[:150] + other[:150]
    texts = [" ".join(long_), " ".join(near), " ".join(other), " ".join(long_), None, "", " ".join(half)]
    kept = simhash.one_of_each(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6] and kept.columns == docs(spark, []).columns
    again = docs(spark, [" ".join(long_)] * 3, ids=[5, 5, None])
    assert simhash.one_of_each(again).count() == 1
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def test_large_group_joins_at_its_origin(spark):
    """Two hundred copies, each edited on its own: near to the origin, not to each other."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    origin = [word() for _ in range(400)]
    texts = []
    for _ in range(200):
        w = list(origin)
        for at in rnd.sample(range(400), 7):
            w[at] = word()
        texts.append(" ".join(w))
    texts.insert(77, " ".join(origin))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(396)} for t in texts]
    near = [len(s & shingles[77]) / len(s | shingles[77]) for s in shingles]
    assert np.median(near) > 0.8 > np.median([len(shingles[i] & shingles[i + 1]) / len(shingles[i] | shingles[i + 1]) for i in range(0, 70)])
    assert simhash.one_of_each(docs(spark, texts)).count() <= 20


def naive_groups(texts, least=0.8, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= least:
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def edited(rnd, word, origin, n):
    w = list(origin)
    for at in rnd.sample(range(len(w)), n):
        w[at] = word()
    return " ".join(w)


def test_copies_are_verified_like_all_pairs(spark):
    """Groups whose pairs lie about the threshold: only pairs at 0.8 link, whatever the bytes say."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    origin, passage = [word() for _ in range(400)], [word() for _ in range(340)]
    texts = [edited(rnd, word, origin, 7) for _ in range(150)]
    for _ in range(120):
        rest = [word() for _ in range(60)]
        texts.append(" ".join(passage + rest))
    texts += [edited(rnd, word, texts[150 + i].split(), 2) for i in range(20)]
    want, _ = naive_groups(texts)
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()}
    assert kept == set(want) and len(kept) > 200


@pytest.mark.parametrize("block", [16, 256])
def test_large_lists_miss_no_pair(spark, monkeypatch, block):
    """Copies of an absent text with 3 to 9 edits each: no member is near to all others."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    origin = [word() for _ in range(400)]
    texts = [edited(rnd, word, origin, rnd.randint(3, 9)) for _ in range(250)]
    want, pairs = naive_groups(texts)
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()}
    assert kept == set(want) and pairs > 500


def test_members_of_blocks_come_one_by_one(spark, monkeypatch):
    """No row that Python gets holds a block: a task of Spark has rows of many blocks on its heap."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    kinds = []
    monkeypatch.setattr(simhash, "arrow_map", lambda df, fn, schema: kinds.append(df.schema.simpleString()) or common.arrow_map(df, fn, schema))
    rnd = random.Random(29)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    origin = [word() for _ in range(200)]
    texts = [edited(rnd, word, origin, rnd.randint(2, 6)) for _ in range(90)]
    assert {r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()} == set(naive_groups(texts)[0])
    assert sum("hashes:binary" in x for x in kinds) == 1 and not [x for x in kinds if "array<" in x]


@pytest.mark.parametrize("rows_a_batch", [1, 2, 100])
def test_block_pairs_wherever_batches_are_cut(rows_a_batch):
    rows = [(task, 3, same, high, n) for task, same, members in [("a", True, [0, 0, 0]), ("b", False, [1, 0, 1]), ("c", False, [0, 0]), ("d", False, [1]), ("e", True, [0])] for n, high in enumerate(members)]
    table = pa.table(dict(zip(["task", "list", "same", "high", "root"], map(list, zip(*[(t, l, s, bool(h), n) for t, l, s, h, n in rows])))))
    got = [(number, [x["root"] for x in low], high and [x["root"] for x in high]) for number, low, high in simhash.block_pairs(iter(table.to_batches(max_chunksize=rows_a_batch)))]
    assert got == [(3, [0, 1, 2], None), (3, [1], [0, 2]), (3, [0], None)]


# 7 HTML


@pytest.fixture(scope="module")
def trees():
    return html_training.fit()


def extract(trees, html):
    p = html_extraction.Page(html)
    return p.text(p.decode(trees.margin(p.features()), html_extraction.CUT))


def test_html_held_out(trees):
    maker, right = html_training.Maker(123), []
    for _ in range(80):
        p = html_extraction.Page(maker.page())
        want = np.array([True, *('data-k="1"' in a for a in p.attrs[1:])])
        right.append(np.mean(p.decode(trees.margin(p.features()), html_extraction.CUT) == want))
    assert np.mean(right) > 0.97


def test_html_of_layouts_never_trained_on(trees):
    maker = OtherPages(31)
    right = [extract(trees, html) == text for html, text in (maker.page() for _ in range(200))]
    assert np.mean(right) >= 0.95


PARTS = [f"Paragraph {i} of the text, it goes on for a while here, and then it ends." for i in range(4)]
ARTICLE = "<article><h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</article>"
FRAME = "<html><head><title>t</title></head><body {}><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About us</a></ul></nav>{}<footer>&copy; 2024 Someone</footer></body></html>"


@pytest.mark.parametrize(
    "page",
    [
        *(FRAME.format(f"class='{c}'", ARTICLE) for c in ("has-sidebar", "comments-open", "post-template single comments-open", "ad-free footer")),
        FRAME.format("", f"<div class='post-with-comments'>{ARTICLE}</div>"),
        FRAME.format("", ARTICLE.replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>")),
        FRAME.format("", ARTICLE).replace("</head>", ""),
        "<html><body><nav><a href='/x'>Home</a></nav>" + ARTICLE,
        "<table><tr><td><a href='/a'>Home</a> <a href='/b'>About us</a></td><td>" + ARTICLE[9:-10] + "</td></tr></table>",
    ],
)
def test_html_with_misleading_frames(trees, page):
    assert extract(trees, page) == "\n".join(["Title of it", *PARTS])


def test_html_keeps_links_of_an_article(trees):
    links = "<ul><li><a href='/1'>First source</a></li><li><a href='/2'>Second source</a></li></ul></article>"
    assert extract(trees, FRAME.format("", ARTICLE.replace("</article>", links))).endswith("ends.\nFirst source\nSecond source")


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>T</title><body><p>Hello <svg><path/><text>no</text></svg>world<p>Two", "Hello world\nTwo"),
        ("<head><meta charset=x>text directly<p>a", "text directly\na"),
        ("<noscript>a<p>b", "a\nb"),
        ("<noscript><p>enable</p></noscript>c", "c"),
        ("<p>x <math><mi>a</mi><mo>+</mo><mn>2</mn></math> y", "x a+2 y"),
        ("<button>go<p>text", "go\ntext"),
        ("<table><tr><td>a<td>b<tr><td>c<p>d<p>e</table>f", "a\nb\nc\nd\ne\nf"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
        ("<p>a<script>var x='</p>'</script>b</p>c", "ab\nc"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p title='a>b'>x</p>", "x"),
        ("<![CDATA[a & b]]>c", "a & bc"),
        ("a<!-- x", "a"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("x<br/>y<hr>z", "x y\nz"),
        ("<textarea>a</textarea>b", "b"),
    ],
)
def test_html_reading(html, text):
    p = html_extraction.Page(html)
    assert p.text(np.ones(len(p.parent), bool)) == text


@pytest.mark.parametrize("piece", ["<div>", "<![CDATA[ x ", "<![CDATA[ x> ", "<!", "<a ", "<a '>' ", "<p><b>", "<section><li>", "<div><td>", "<script></script ", "<select><option>", '<a b="x>', "<noscript>x", "<b></i>"])
def test_html_in_linear_time(piece):
    """Four times the page takes about four times as long, not sixteen times."""
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        html_extraction.Page(piece * (n // 2)).features()
        took.append(time.process_time() - start)
    assert took[1] < 8 * max(took[0], 0.05)


def test_html_decoding_is_the_best_choice():
    rng = np.random.default_rng(8)
    p = html_extraction.Page("<div><ul><li>a<li>b</ul><p>c<p>d</div><div><p>e</div>")
    n = len(p.parent)
    for _ in range(20):
        m = rng.normal(size=n)
        stay, go = -np.log1p(np.exp(-m)), -np.log1p(np.exp(m))
        legal = [c for c in range(1 << n) if c & 1 and all(not c >> i & 1 or c >> p.parent[i] & 1 for i in range(1, n))]
        best = max(legal, key=lambda c: sum(stay[i] if c >> i & 1 else go[i] for i in range(1, n)))
        assert [bool(best >> i & 1) for i in range(n)] == p.decode(m).tolist()


def test_html_pages(spark, trees):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head&amp;line</h1><p>One\n two <b>three</b><br>four &lt;5.<p>Second para of this text, here it goes on.</article><section id='comments'><p>Nice!</p></section><script>x</script><footer>&copy; 1</footer>"
    assert extract(trees, page) == "Head&line\nOne two three four <5.\nSecond para of this text, here it goes on."
    rows = [(i, "u", h) for i, h in enumerate([None, "", "<", page, "<div>" * 3000 + "x", page])]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).orderBy("page_id").collect()
    assert got[0]["text"] == got[1]["text"] == "" and got[3]["text"] == got[5]["text"] and got[3]["n_chars"] == len(got[3]["text"])


def test_boosting_learns():
    from tidemark.llm.boosting import BoostedTrees

    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(40, 3).fit(x[:1500], y[:1500])
    assert np.mean((m.margin(x[1500:]) > 0) == y[1500:]) > 0.95


# 8 token counts


@pytest.mark.parametrize(("chunk", "overlap", "long"), [(97, 8, 300), (64, 2, 70), (1 << 14, 256, 1 << 15)])
def test_token_counts(chunk, overlap, long, rows):
    c = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), chunk, overlap, long)
    rnd = random.Random(10)
    bits = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "ﬁ", "①", "😀", "<s>", "x" * 40, "中文", "\t", "0", ".", "\x00", "<0x0A>"]
    texts = [r["text"] for r in rows[:60]] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 300))) for _ in range(500)] + ["x" * 2000, "中" * 900, " " * 1000, "", " ", "a "]
    assert c.count_all(texts) == [len(c.sp.encode(t)) for t in texts]


def test_token_table(spark):
    got = by_id(token_counts.count_tokens(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model"), 100), "n_bytes", "n_tokens", "over_limit")
    assert got[0] == got[1] == (0, 0, False) and got[9][0] == len(LONG) and got[9][2]


# 9 quality


def test_quality(spark):
    spark_docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(spark_docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(quality.score_quality(docs(spark, ODD), none), "score", "predicted")
    assert len(got) == len(ODD) and all(0 <= s <= 1 for s, _ in got) and got[0] == got[1] and got[5] == got[6]


def test_normal_equations_and_isotonic(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(300, quality.N_STATISTICS)), rng.integers(0, 2, 300).astype(float)
    f = quality.Features(x.mean(0), x.std(0), 16)
    t = spark.createDataFrame([(a.tolist(), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))], "x array<float>, y double, fold int").repartition(5)
    z = f(x.astype(np.float32).astype(float))
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 3 * np.eye(17), z.T @ y)
    sums = quality.normal_equations(t, f, 16)
    assert np.allclose(quality.solve(sums.sum(axis=0)), want, atol=1e-6)
    assert np.allclose(sums[1][:, :-1], z[1::4].T @ z[1::4], atol=1e-6)
    level = quality.isotonic(np.array([4, 4, 4, 4.0]), np.array([1, 3, 2, 4.0]))
    assert (np.diff(level) >= 0).all() and level[1] == level[2] == pytest.approx(5.5 / 9)


# 10 media


def test_media(spark):
    got = by_id(media.store_media(docs(spark, ODD)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature", "media")
    for t, g in zip(ODD, got):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert g[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and hashlib.sha256(g[6]).hexdigest() == g[4]
    assert got[5] == got[6] and got[0] == got[1]


def test_png_filters_and_damage():
    rng = np.random.default_rng(12)
    for step in (1, 2, 3, 4):
        rows = rng.integers(0, 256, (20, 6 * step), dtype=np.uint8)
        kinds = rng.integers(0, 5, 20)
        filtered = np.zeros_like(rows)
        for i, kind in enumerate(kinds):
            for j in range(rows.shape[1]):
                a = int(rows[i, j - step]) if j >= step else 0
                b = int(rows[i - 1, j]) if i else 0
                c = int(rows[i - 1, j - step]) if i and j >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                filtered[i, j] = (int(rows[i, j]) - [0, a, b, (a + b) // 2, near][kind]) % 256
        assert (media.unfilter(filtered, kinds, step) == rows).all()
    good = media.write_png(media.pad(b"hello"))
    for bad in (good[:50], b"x" + good, good[:60] + bytes([good[60] ^ 1]) + good[61:]):
        with pytest.raises(media.PngError):
            media.read_png(bad)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = docs(spark, PIPE + ["a b c " * 30, "12 34"])
    table = d.select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    import tempfile

    at = tempfile.mkdtemp()
    rows = [r.asDict() for r in table.collect()] + [{"doc_id": 50, "text": "Say: " + ITEM, "lang": "en", "source": "s", "n_chars": 1}, {"doc_id": 51, "text": "the password = abcdefghijkl1 of it", "lang": "en", "source": "s", "n_chars": 1}]
    spark.createDataFrame(rows, table.schema).write.parquet(f"{at}/documents.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    got = corpus_pipeline.run(spark, at)
    assert {r["doc_id"] for r in got.collect()} == {2, 4, 5, 51}
    step = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, at)
        assert step.columns == table.columns, name
    text = step.where("doc_id = 51").first()
    assert text["text"] == "the [assign] of it" and text["n_chars"] == len(text["text"])


def test_nothing_else_imports_this():
    import ast
    from pathlib import Path

    root = Path(simhash.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node), p
    assert F is not None
