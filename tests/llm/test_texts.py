"""Tokenization, packing and text quality on fixtures and brute force."""

from __future__ import annotations

import random
import re
import time

import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA

from tesela.llm import packing, quality, queries, tokens


@pytest.fixture(scope="module")
def model(spark):
    """Trained on the texts of the test data."""
    return quality.train(quality.document_features(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")))


@pytest.fixture(scope="module")
def automaton():
    return tokens._compiled(tokens.pack_vocabulary())


def test_equal_to_the_public_encoder_and_round_trip(spark, automaton):
    t = Tokenizer.from_file(tokens.DEFAULT_PATH)
    t.encode_special_tokens = True
    rng = random.Random(0)
    bits = ["a", "aa", "the", " ", "  ", "é", "日本", "🎉", "12", "_", "\n", "'s", "<|endoftext|>", "\x00", "zzz", "ing", "-", "===", "A"]
    texts = ["", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(2000)], *["a" * n for n in range(40)], "word " * 20_000, "x" * 3000]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text]
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for x, ids in zip(texts, expected):
        assert automaton.encode(x) == ids and automaton.decode(ids) == x
    assert automaton.encode(None) == []


def test_arcs_are_those_of_canonical_sequences(automaton):
    """An arc exists iff encoding both labels together gives back the two tokens."""
    rng = random.Random(5)
    for _ in range(3000):
        p, w = rng.randrange(50_256), rng.randrange(50_256)
        whole = automaton.labels[p] + automaton.labels[w]
        try:
            word = whole.decode()
        except UnicodeDecodeError:
            continue
        assert automaton.arc(p, w) == (automaton.encode_word(word) == (p, w)) or whole in automaton.ids


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a"), (3, " a")], "doc_id long, text string")
    rows = tokens.encode_documents(df).collect()
    assert [r.ids for r in rows] == [[], [], [257], [257]]


def test_every_document_has_ids(spark, edge_dir):
    got = queries.QUERIES["p8_ids"](spark, edge_dir)
    assert got.count() == spark.read.parquet(f"{edge_dir}/documents.parquet").count() and got.where("ids IS NULL").count() == 0


def best_fit(sizes, capacity):
    space = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fit = [i for i, r in enumerate(space) if r >= s]
        if fit:
            i = min(fit, key=lambda i: space[i])
            space[i] -= s
        else:
            space.append(capacity - s)
    return sorted(space)


def test_plan_equals_best_fit_one_by_one(spark):
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        h = {rng.randint(0, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        slots, n = packing.plan_slots(h, capacity)
        used: dict = {}
        seen: dict = {}
        for size, a, b, first, per, order in slots:
            for r in range(a, b):
                used.setdefault(first + (r - a) // per, []).append((order + (r - a) % per, size))
                seen[size] = seen.get(size, 0) + 1
        assert seen == h
        assert all(sorted(o for o, _ in v) == list(range(len(v))) for v in used.values())
        if any(h):
            assert sorted(capacity - sum(s for _, s in v) for v in used.values()) == best_fit([s for s, c in h.items() for _ in range(c)], capacity)


def test_packing_keeps_every_piece(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 7, 7, 7, rng.randint(1, 40), 130, None])) for i in range(900)]
    out = packing.pack(spark.createDataFrame(sizes, "doc_id long, n int"), "doc_id", "n", 50).collect()
    total: dict = {}
    load: dict = {}
    places = set()
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r["size"]
        load[r.container] = load.get(r.container, 0) + r["size"]
        places.add((r.container, r.item_order))
        assert r.start == r.piece_no * 50
    assert total == {i: n or 0 for i, n in sizes} and max(load.values()) <= 50 and len(places) == len(out)
    pieces = [min(50, n - a) for _, n in sizes if n for a in range(0, n, 50)]
    assert sorted(50 - v for v in load.values() if v) == best_fit(pieces, 50)


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("El perfil institucional se explica por el crecimiento de los posgrados, aunque las diferencias son pequeñas.", "prose"),
        ("The share of open access papers has changed with the position of the author\nin the list, since the first call was opened.", "prose"),
        ("- soil use\n- lake model\n- forest yield\n- urban growth", "list"),
        ("1) soil use\n2) lake model\n3) forest yield", "list"),
        ("soil use; lake model; forest yield; urban growth; open index", "list"),
        ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "table"),
        ("tema\t2019\t2020\nsoil\t1\t2.5\nlake\t3\t4%", "table"),
        ("name;n;%\nsoil use;12;1.5\nlake;7;0.2", "table"),
        ("1995    12.5    8.1\n1996    7.2    9.9\n1997    7.7    1.9", "table"),
        ("id: soil\nscore: 12\nlag: 0.3\nid: lake\nscore: 7\nlag: 0.1", "table"),
        ("haga clic aquí " * 12, "junk"),
        ("rjl gpntzywr frokf bwfrpkup yiuyauiysqqoq xbqoquohlirde jkdsev jlaebrcew iezkx vtszeucefwzc xclyawaevgid dbzybyp", "junk"),
        ("auqz/5f0x70FJrvzDfyLBoFi9Sx89hr1QTZ2rWgZtJHle5n7ryHSfkMXLR4+h56ZVrsaYvcIpYWPa", "junk"),
        ("L a c o l a b o r a c i ó n e n t r e l o s d o s", "junk"),
    ],
)
def test_forms(spark, model, text, form):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.label_documents(quality.document_features(docs), model).collect()[0].form == form


def test_held_out_forms(spark, model):
    """Planted documents of every form, of words and shapes that the training texts do not have: accuracy of 0.9 or more per form."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("bdklmnrst", "aeiou")[i % 2]) for i in range(rng.randint(4, 9)))
    phrase = lambda k: " ".join(word() for _ in range(k))
    common = "the of and to in that was for with as on by from is the a".split()
    sentence = lambda: (" ".join(x for _ in range(rng.randint(5, 14)) for x in (rng.choice(common), word())) + ".").capitalize()
    make = {
        "prose": [lambda: " ".join(sentence() for _ in range(rng.randint(1, 40))), lambda: "\n".join(sentence() for _ in range(rng.randint(2, 9)))],
        "list": [lambda: "\n".join(f"{rng.choice('-*•')} {phrase(rng.randint(1, 5))}" for _ in range(rng.randint(3, 30))), lambda: "\n".join(f"{i}. {phrase(3)}" for i in range(1, rng.randint(4, 30))), lambda: "; ".join(phrase(2) for _ in range(rng.randint(6, 200)))],
        "table": [lambda: (lambda k, d: "\n".join(d.join([phrase(1), *[f"{rng.random() * 90:.1f}" for _ in range(k)]]) for _ in range(rng.randint(3, 20))))(rng.choice([2, 4, 120]), rng.choice(["\t", ";", "   "])), lambda: "\n".join(f"| {word()} | {rng.randint(1, 99)} | {word()} |" for _ in range(6))],
        "junk": [lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(8, 60))), lambda: (phrase(1) + " ") * rng.randint(15, 200), lambda: " ".join("".join(phrase(rng.randint(6, 30)).split())), lambda: "".join(rng.choice("$%&*+=_#?<>{}@^~ ab") for _ in range(rng.randint(60, 900)))],
    }
    rows = [(i, form, kinds[i % len(kinds)]()) for form, kinds in make.items() for i in range(60)]
    docs = spark.createDataFrame([(k, f, t) for k, (_, f, t) in enumerate(rows)], "doc_id long, want string, text string")
    got = docs.join(quality.label_documents(quality.document_features(docs), model), "doc_id").collect()
    right = {f: sum(r.form == f for r in got if r.want == f) / 60 for f in make}
    assert min(right.values()) >= 0.9, right


def test_statistics_of_a_text():
    n, mean, symbols, ended, common, kinds, sizes = quality.text_features("The soil, of a lake.\n\n- one")
    assert (n, ended, len(kinds), sizes) == (6, 0.5, 2 * len(quality.FEATURES), [20, 5]) and mean == pytest.approx(17 / 6) and common == pytest.approx(3 / 6) and symbols > 0
    assert quality.text_features("")[:5] == (0, 0.0, 0.0, 0.0, 0.0)
    assert quality.text_features(" \n\t ")[5] == b""


def test_statistics_equal_their_plain_definitions():
    """Searches that are left out, where a cheaper one finds nothing, would have found nothing."""
    rng = random.Random(7)
    signs = [*"aeiouàÀçbcdfgXYZWßİΣςж漢０５²ª_'’`019.,;:|/·•-–*+()[]{}<>#$%&=~^@©Ã¡?…”» \t  \n\x1c\x85\u2028", "1. ", "- ", "key: ", " | ", "; ", "  ", "(1999)", "....12", "the ", "xbcdfg ", "don't ", "| a | b |\n", "a b c d e f g h "]
    names = list(quality.FEATURES)
    count = lambda pattern, text: len(re.findall(pattern, text))
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 90)))
        n_words, mean, ratio, ended, _, lines, sizes = quality.text_features(text)
        every = [x.strip() for x in text.splitlines() if x.strip()]
        words = [re.findall(r"[^\W_]+(?:['’][^\W_]+)?", x.lower()) for x in every]
        letters = [sum(map(len, w)) for w in words]
        assert n_words == sum(map(len, words)) and sizes == [*map(len, every)] and mean == (sum(letters) / n_words if n_words else 0)
        assert ratio == max(0, len("".join(text.split())) - sum(letters)) / len(text)
        assert ended == (sum(x.endswith(quality._ENDS) for x in every) / len(every) if every else 0)
        for i, (x, w, k) in enumerate(zip(every, words, letters)):
            got = dict(zip(names, lines[i * len(names) :]))
            tokens = x.split()
            signs_ = max(0, len("".join(tokens)) - k)
            digits = sum(bool(re.search(r"\d", y)) for y in tokens) / len(tokens)
            noise = count(r"[$%&*+=_#?¡¿<>{}@^~\\©€™�Ã¤¦§¬¢]", x) / len(x) if signs_ else 0
            items = 1 + count(r"[,;|·•/]\s", x)
            assert got["digits"] == (digits > 0) + sum(digits >= b for b in (0.25, 0.5))
            assert got["signs"] == sum(signs_ / len(x) >= b for b in (0.03, 0.08, 0.2))
            assert got["noise"] == (noise > 0) + sum(noise >= b for b in (0.025, 0.08))
            assert got["items"] == (0 if items < 3 else 1 if len(w) <= 4 * items else 2)
            assert got["year"] == bool(re.search(r"\((?:19|20)\d\d[a-z]?\)", x))
            assert (got["shape"] == 5) <= (len(tokens) >= 3 and count(quality._RUN.pattern, x) >= 0.35 * len(tokens)) and (got["shape"] in (0, 6)) <= (len(tokens) < 3 or count(quality._RUN.pattern, x) < 0.35 * len(tokens))


def test_statistics_cost_few_passes_over_a_text():
    """All statistics of prose take less than four times the CPU time of finding its words by a pattern (before: more than five times)."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("bdklmnrst", "aeiou")[i % 2]) for i in range(rng.randint(3, 9)))
    text = "\n".join(" ".join(word() for _ in range(30)).capitalize() + f", {word()}." for _ in range(2000))

    def seconds(run) -> float:
        began = time.thread_time()
        run()
        return time.thread_time() - began

    ratios = [seconds(lambda: quality.text_features(text)) / seconds(lambda: [quality._WORD.findall(x.lower()) for x in text.splitlines()]) for _ in range(9)]
    assert sorted(ratios)[4] < 4, ratios


def test_null_empty_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, " ".join(f"La red de citas depende de lago{i} y de los autores." for i in range(40_000)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [rows[i].form for i in (1, 2, 3, 4)] == [None, None, None, "prose"] and rows[4].n_words == 440_000


def test_posteriors_sum_to_one_and_counts_match():
    import numpy as np

    rng = np.random.default_rng(0)
    codes = np.stack([rng.integers(0, b, (7, 9)) for b in quality.FEATURES.values()], 2).astype(np.uint8)
    start = quality.LineModel.starting()
    post, moves = start.posteriors(codes)
    assert np.allclose(post.sum(2), 1) and np.isclose(moves.sum(), 7 * 8)
    assert all(np.allclose(e.sum(1), 1) for e in start.emit) and np.allclose(start.move.sum(1), 1)
    # against brute force over all paths of two lines
    lik = start.likelihoods(codes[:1, :2])[0]
    joint = start.start[:, None] * lik[0][:, None] * start.move * lik[1][None, :]
    assert np.allclose(start.posteriors(codes[:1, :2])[0][0], [joint.sum(1) / joint.sum(), joint.sum(0) / joint.sum()])


def test_wide_rows_are_rows(spark, model):
    """The form of a table does not depend on the length of its lines, nor that of prose on a stray separator."""
    cells = [f"value {i}" if i % 2 else f"{i}.5" for i in range(80)]
    prose = "the share of the works that were cited by others in the years after they came out is shown for all of the fields. " * 6
    rows = ["\t".join(cells), "| " + " | ".join(cells) + " |", ";".join(cells), "   ".join(cells)]
    texts = ["\n".join([r] * 3) for r in rows] + [prose, prose.replace("fields. ", "fields.\t", 1), prose.replace(" the years ", "  2006  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    form = {r.doc_id: r.form for r in quality.label_documents(quality.document_features(docs), model).collect()}
    assert [form[i] for i in range(7)] == ["table"] * 4 + ["prose"] * 3
