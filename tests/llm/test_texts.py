"""Token ids, leaked passages and abusive language against brute force, other libraries and on awkward input."""

import os
import random

import abuse_sentences
import pytest

from tonelake.llm import abuse, folding, leakage, lexicon, tokens
from tonelake.llm.lexicon import squeeze

TRICKY = ["", " ", "\n\n \t x", "a" * 3000, "ab " * 500, "\x1c a\x1d b\x85 c᠎ d e 　 x", "​﻿ x", "😀" * 60, "１２３ ½ Ⅷ", "don't I'LL we've", "<|endoftext|>", "日本語のテキスト", "مرحبا", "é", "-" * 999]


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(tokens.read_ranks(f.read()))


def slow_merge(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_like_brute_force(encoder):
    rng = random.Random(3)
    for _ in range(400):
        piece = bytes(rng.choice(b"aaabbcdeth in\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        whole = encoder.merger.ranks.get(piece)
        assert encoder.merger.encode(piece) == ([whole] if whole is not None else slow_merge(encoder.merger.ranks, piece))


def test_ids_of_other_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = TRICKY + ["".join(rng.choice("ab é'\n\t1٣漢😀-.  ") for _ in range(rng.randrange(80))) for _ in range(500)]
    assert [encoder.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_empty_texts(spark, encoder):
    rows = list(enumerate([*TRICKY, None, TRICKY[4]]))
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("*", "0 AS ids", "0 AS text")
    back = {i: b for b, i in encoder.merger.ranks.items()}
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, "id", "t").collect()}
    assert len(got) == len(rows) and all(b"".join(back[i] for i in got[k]).decode() == (t or "") for k, t in rows)
    assert got[0] == [] and got[len(TRICKY)] == [] and got[1] != []
    assert tokens.encode_corpus(df.limit(0), "id", "t").count() == 0


def test_words_as_read():
    plain = "in an unheated attic above ostermoor a train guards tent".split()
    for shown in [
        "In an unheated attic above Ostermoor, a train guard's tent", "Ｉｎ ａｎ ｕｎｈｅａｔｅｄ ａｔｔｉｃ ａｂｏｖｅ Ｏｓｔｅｒｍｏｏｒ， ａ ｔｒａｉｎ ｇｕａｒｄ’ｓ ｔｅｎｔ", "Íñ án üñheated áttic âbove Östermöor, a träin guard&#x27;s tent", "In an un­heat​ed attic **above** _Ostermoor_, a trаin guard&rsquo;s tеnt",
        "<p>In an <b>un</b>heated attic</p>\n> above\n> Ostermoor, a train guard's tent", "In — an — unheated — attic — above — Ostermoor — a — train — guard's — tent", "In an unheat-\ned attic above Ostermoor; a train guard\\u0027s tent", "In an unheated attic above Ã–stermoor, a train guardâ€™s tent",
    ]:
        assert folding.words(shown) == plain, shown
    assert folding.words(None) == [] and folding.words(" \n") == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_leak(item, text):
    """Whether any passage of the item shows, by trying all of them."""
    a, b = folding.words(item), folding.words(text)
    exact = {tuple(a[i : i + leakage.EXACT]) for i in range(len(a) - leakage.EXACT + 1)}
    if any(tuple(b[j : j + leakage.EXACT]) in exact for j in range(len(b))):
        return True
    for n in range(leakage.LOOSE, len(a) + 1):
        for i in range(len(a) - n + 1):
            row = [0] * (len(b) + 1)  # a passage may begin anywhere in the text
            for p, x in enumerate(a[i : i + n], 1):
                new = [p]
                for j, y in enumerate(b, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= n // 6:
                return True
    return False


def test_leaks_like_brute_force():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    seen = set()
    for _ in range(120):
        item = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 50))]
        n = rng.randrange(8, 48)
        begin = rng.randrange(max(1, len(item) - n + 1))
        part = list(item[begin : begin + n])
        for _ in range(rng.choice([0, 1, len(part) // 6, len(part) // 6 + 1, 9])):
            k = rng.randrange(max(1, len(part)))
            part[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)], ["new", "x"]])
        text = " ".join([rng.choice(vocabulary) for _ in range(5)] + part + [rng.choice(vocabulary) for _ in range(5)])
        want = slow_leak(" ".join(item), text)
        seen.add(want)
        assert bool(leakage.Matcher([(1, " ".join(item))]).match(text)) == want
    assert seen == {True, False}


def test_myers_distance():
    rng = random.Random(7)
    for _ in range(60):
        item = leakage.Item(1, [rng.choice("abcdef") for _ in range(30)])
        text = [rng.choice("abcdefg") for _ in range(40)]
        want = min(edit_distance(item.tokens[i : i + 22], text[j:k]) for i in range(9) for j in range(0, 40, 1) for k in range(j, min(40, j + 26) + 1))
        assert leakage.least_errors(item, 22, text, -1) == want


def test_leaks_of_awkward_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, " "), (5, "x " * 50_000 + item), (6, item.replace("three", "3")), (7, item.rsplit(" ", 2)[0])], "id bigint, t string").selectExpr("*", "0 AS doc_id", "0 AS text", "0 AS item_id")
    items = spark.createDataFrame([(10, item), (11, item), (12, None), (13, "short"), (14, "")], "id bigint, t string").selectExpr("*", "0 AS item_id")
    for block in (5_000, 2):
        got = leakage.leaks(docs, "id", "t", items, "id", "t", block)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted([(d, i) for d in (1, 1, 5) for i in (10, 11)])
    assert leakage.leaks(docs, "id", "t", items.limit(0), "id", "t").count() == 0
    assert leakage.leaks(docs.limit(0), "id", "t", items, "id", "t").count() == 0


SCORER = abuse.Scorer(abuse.ordinary_words(abuse.read_vocabularies()))
ABUSIVE = [
    "You are an idiot.", "u are such a f*cking m0r0n", "Shut up, you stuuupid p i g", "Whoever mixed this is a worthless clоwn", "I will break your fingers", "K**l yourself", "go choke on a cable, loser", "Immigrants are vermin", "Women should be kept out of the control room", "we must get rid of those refugees",
    "I want to lick you all over", "nice t_i_t_s, send me your nudes", "Du bist ein wertloses Stück Dr3ck", "Ferme ta gueule, espèce de c.o.n.n.a.r.d", "Te voy a partir la cara, hijo de puta", "Stai zitto, pezzo di m e r d a", "Cala a boca, seu !d!07a de m3rd@", "Die Ausländer sind Parasiten", 'He said hello. You sc​umbag, "nice" take', "the engineer is a total asshole",
]
HARMLESS = [
    "", "This mix is garbage and I hate the reverb.", "Holy shit, that bass line is gorgeous.", "I was such an idiot, the cable was unplugged.", "We will smash the limiter on the snare.", "Version B kills version C.", 'A participant complained because someone had written "You are an idiot, drop dead" to them.',
    'We do not accept messages such as "Women are vermin" here.', "Our rules: no insults such as moron or clown.", "The moderator deleted a reply because it called another member an idiot.", "The paper studies hateful comments about women.", "Women were well represented in the panel.", "Let me hear the naked vocal.", "Suck the mud out of the bass.",
    "Stupid question maybe, but how do I bounce stems?", "A dirty bass and a filthy groove.", "A classic cocktail of brass and analog assembly noise.", "The listener may weigh the bass.",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abusive(text):
    assert SCORER.score(text)[0] >= abuse.FLAG


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert SCORER.score(text)[0] < abuse.FLAG


def test_automaton_like_brute_force():
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(40)}
    words = {w for w in words if len(squeeze(w)) >= 4}
    reader = lexicon.Lexicon(words, words)
    for _ in range(400):
        t = squeeze("".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))))
        for budget in (1, 2):
            near = {w: edit_distance(squeeze(w), t) for w in words if edit_distance(squeeze(w), t) <= budget}
            got = reader.near(t, budget)
            assert set(near) <= set(got) and all(got[w] <= e for w, e in near.items())
            assert all(edit_distance(squeeze(w), t) <= 2 * e for w, e in got.items())  # swaps are one edit here, two there
        assert set(reader.near(t, 0)) == {w for w in words if squeeze(w) == t}


def test_one_edit_is_read_back():
    """Misspellings with one edit, by the length of the lexicon's word; those that are ordinary words are no misspellings."""
    rng = random.Random(1)
    right, asked = {}, {}
    for w in sorted(SCORER.fuzzy):
        n = len(squeeze(w))
        for _ in range(6 if n >= 4 and w.isascii() else 0):
            i, c = rng.randrange(len(w)), rng.choice("abcdefghijklmnopqrstuvwxyz")
            v = rng.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
            if v != w and not SCORER.is_ordinary(v) and v not in SCORER.tags and len(squeeze(v)) >= 3:
                asked[n] = asked.get(n, 0) + 1
                right[n] = right.get(n, 0) + (w in SCORER.words_of(v))
    assert all(right[n] >= 0.9 * asked[n] for n in asked if asked[n] >= 20), {n: (right[n], asked[n]) for n in asked}


def test_rows_come_through_the_automaton(monkeypatch):
    texts = ["You are an id1ot", "you f*cking mor0n", "what a basterd you are", "you stuuupid cow"]
    assert all(SCORER.score(t)[0] >= abuse.FLAG for t in texts)
    blind = abuse.Scorer(SCORER.ordinary)
    monkeypatch.setattr(lexicon.Lexicon, "near", lambda self, token, budget: {})
    assert not any(blind.score(t)[0] >= abuse.FLAG for t in texts[:3])


@pytest.mark.parametrize("text", abuse_sentences.ABUSIVE)
def test_abusive_sentence(text):
    assert SCORER.score(text)[0] >= abuse.FLAG


@pytest.mark.parametrize("text", abuse_sentences.HARMLESS)
def test_harmless_sentence(text):
    assert SCORER.score(text)[0] < abuse.FLAG


def test_quotations_of_any_length():
    report = 'The moderator removed the message "' + "la " * 4000 + 'you are an idiot" from the forum.'
    assert SCORER.score(report)[0] < abuse.FLAG <= SCORER.score(report.replace("The moderator removed the message", "Well"))[0]
    assert abuse.quotations("“a " * 50_000) == []  # linear


def test_scores_of_awkward_tables(spark):
    long = "fine mix. " * 30_000 + "You are an idiot."
    df = spark.createDataFrame([(1, "You are an idiot."), (1, "You are an idiot."), (2, None), (3, ""), (4, " \n"), (5, long), (6, "�" * 100)], "id bigint, t string").selectExpr("*", "0 AS doc_id", "'s' AS score", "0 AS text")
    got = sorted((r.doc_id, r.score >= abuse.FLAG) for r in abuse.scores(df, "id", "t").collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, False)]
    assert abuse.scores(df.limit(0), "id", "t").count() == 0


def test_agreement_with_reviews():
    """Held-out accuracy: documents on which at least two reviewers agree."""
    from compare import DATA, connection, have_data

    if not have_data():
        pytest.skip("no test tables here")
    rows = connection().execute(f"SELECT any_value(text), sum(flagged), count(*) FROM '{DATA}/documents.parquet' JOIN '{DATA}/doc_reviews.parquet' USING (doc_id) GROUP BY doc_id HAVING count(*) > 1 AND (sum(flagged) = 0 OR sum(flagged) = count(*))").fetchall()
    right = sum((SCORER.score(t)[0] >= abuse.FLAG) == (f > 0) for t, f, _ in rows)
    assert right >= 0.9 * len(rows)


@pytest.mark.parametrize("at", [0, 700, 798, 1560, 1600])
def test_loose_leak_inside_a_long_stretch(at):
    """Pieces of the item all along the text make one stretch of many blocks; the passage may lie across a block's edge."""
    item = [f"w{i}" for i in range(60)]
    filler = [w for k in range(1600) for w in ([f"w{(k * 7) % 50 + j}" for j in range(4)] + ["zz"])]
    passage = item[10:36]
    passage[5], passage[12], passage[19] = "x", "y", "z"
    matcher = leakage.Matcher([(1, " ".join(item))])
    text = filler[: at * 5] + passage + filler[at * 5 :]
    assert not matcher.match(" ".join(filler)) and matcher.match(" ".join(text)) == [(1, "loose", 3)]


def test_boilerplate_items_are_asked_together():
    import time

    rng = random.Random(1)
    common = "please read the following text and answer the question below".split()
    items = [(i, " ".join(common + [f"w{rng.randrange(20_000)}" for _ in range(40)])) for i in range(3000)]
    matcher = leakage.Matcher(items)
    text = " ".join(w for _ in range(850) for w in common + [f"w{rng.randrange(20_000)}" for _ in range(4)])
    begin = time.perf_counter()
    assert matcher.match(text) == [] and matcher.match(f"{text} {items[77][1]}") == [(77, "exact", 0)]
    assert time.perf_counter() - begin < 1


def test_marks_of_any_length_and_number():
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar"
    matcher = leakage.Matcher([(1, item)])
    for n in (1, 2, 3):
        assert matcher.match(item.replace(" ", "%20", n)) == [(1, "exact", 0)]
    for mark in (f"<!-- {'x ' * 400} -->", f'<a href="{"y" * 900}">'):
        assert matcher.match(item.replace(" ", f" {mark}", 1)) == [(1, "exact", 0)]
    style = "x" * 2000
    assert folding.words(f'one <span style="{style}">two</span> three <!-- {style} <p> --> four <p class="{style}">five') == ["one", "two", "three", "four", "five"]
    assert folding.words("the+mix+caf%C3%A9+is") == ["the", "mix", "cafe", "is"]
    assert folding.words("the caf%C3%A9 at 5%20 or so") == ["the", "cafe", "at", "5", "20", "or", "so"]
    assert folding.words("left <!-- open " * 20_000)[:3] == ["left", "open", "left"]  # linear
