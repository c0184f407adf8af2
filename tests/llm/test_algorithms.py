"""Names, terms, pairs and linkage on fixtures and on edge-case tables."""

from __future__ import annotations

import itertools
import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows_of

from tesela.functions.ids import registry_key
from tesela.llm import entities, linkage, names, organizations, pairs, queries, sparse, terms, variants

FOUND = [q for q in queries.QUERIES if q.endswith("_found")]


@pytest.mark.parametrize("name", FOUND + ["p8_ids", "p9_containers", "p6_pairs"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_nulls_repeats_and_extra_columns_change_nothing(spark, edge_dir, name):
    assert rows_of(queries.QUERIES[name](spark, edge_dir)) == rows_of(queries.QUERIES[name](spark, DATA))


def test_person_tokens_and_parts():
    """Commas decide; without one, the words' usual places do; capitals that no name writes otherwise are initials."""
    assert names.person_tokens("Dr. BenjamÃ\xadn de Soto-Lara") == (["benjamin", "soto", "lara"], [2, 2, 2], [0, 0, 0])
    assert names.person_tokens("G.C. Brosa")[0] == ["g", "c", "brosa"] and names.person_tokens("")[0] == [] and names.person_tokens("  ,  ")[0] == []
    assert names.person_tokens("王 伟")[0] == ["王", "伟"] and names.person_tokens("Łukasz Ørsted")[0] == ["łukasz", "ørsted"]
    stat = {"ramon": (1, 50, 40), "soto": (60, 1, 40), "lara": (50, 2, 40), "lee": (5, 0, 3)}

    def parse(name):
        words, sides, caps = names.person_tokens(name)
        return names.parse_person([(s, c, [(w, *stat.get(w, (0, 0, 0)))]) for w, s, c in zip(words, sides, caps)])

    for name in ("Soto Lara, Ramón", "Ramón Soto Lara", "SOTO LARA RAMON", "Soto-Lara Ramón"):
        assert parse(name) == (["ramon"], ["soto", "lara"])
    assert parse("Soto LA") == (["l", "a"], ["soto"]) and parse("LA Soto") == (["l", "a"], ["soto"]) and parse("LEE, John") == (["john"], ["lee"]) and parse("R. Soto L.") == (["r"], ["soto", "l"])


def test_forms_are_the_shortened_names():
    assert names.forms(["ana", "luz"], ["soto", "lara"]) == sorted({f"{g}|{f}" for g in ("a", "ana", "a l", "ana l", "ana luz") for f in ("soto", "soto l", "soto lara")} - {"ana luz|soto lara"})
    assert names.forms([], ["soto"]) == [] and len(names.forms(["a"] * 30, ["b"] * 30)) < 300_000


def test_organization_pieces():
    assert names.organization_pieces("Campus Sur, Univ. Autón. Tlaravila (UATL)") == (["campus sur", "univ auton tlaravila"], "", "uatl")
    assert names.organization_pieces("UATL-Tlaravila") == (["tlaravila"], "uatl", "") and names.organization_pieces("U.A.T.L.") == ([], "uatl", "")
    assert names.organization_pieces("EL COLEGIO DE RIO") == (["el colegio de rio"], "", "") and names.organization_pieces("") == ([], "", "")


def test_one_edit():
    for a, b in (("abcd", "abcd"), ("abcd", "abdc"), ("abcd", "abxd"), ("abcd", "abd"), ("abcd", "xabcd")):
        assert names.near(a, b)
    for a, b in (("abcd", "badc"), ("abcd", "ab"), ("abcd", "axyd")):
        assert not names.near(a, b)


def test_cosine_join_loses_no_pair(spark):
    """Against all pairs: every one at the threshold is found, with its cosine; top_n keeps the best."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 11))) for _ in range(160)})
    grams = lambda c: sparse.gram_features(c, 2)
    df = spark.createDataFrame([(w,) for w in words], "id string").withColumn("features", grams(F.col("id")))
    weights = sparse.feature_weights(df)
    vector = {r.id: {f: float(weights[f]) ** 2 for f in r.features} for r in df.collect()}
    want = {}
    for a, b in itertools.permutations(words, 2):
        c = sum(v for f, v in vector[a].items() if f in vector[b]) / (sum(vector[a].values()) * sum(vector[b].values())) ** 0.5
        if c >= 0.5:
            want[a, b] = c
    join = lambda top: {(r.a.id, r.b.id): r.cosine for r in sparse.cosine_join(df, df, weights, 0.5, F.lit(True), lambda x: grams(F.col(f"{x}.id")), top).collect()}
    assert join(None) == pytest.approx(want) and want
    assert {a: c for (a, _), c in join(1).items()} == pytest.approx({a: max(c for (x, _), c in want.items() if x == a) for a, _ in want})


def test_slips_are_rare_relative_to_their_word(spark):
    """However often a slip occurs; two frequent words one edit apart stay, a slip of a slip gets the word itself, short and joined words are repaired too."""
    words = [("sachichirga", 60), ("sachochirga", 9), ("zachochirga", 1), ("pliyabonza", 100), ("pliyabonsa", 60), ("cejegulla", 5), ("cejegula", 2), ("rugutrondi", 2), ("ruguttrondi", 1), ("daniel", 400), ("daniela", 380)]
    short = [("lopez", 30), ("lozez", 1), ("garcia", 30), ("gacria", 2), ("ruiz", 30), ("riuz", 1), ("vega", 30), ("veg", 1), ("lopezruiz", 1), ("иванов", 40), ("иваонв", 1)]
    got = {r.word: r.fixed for r in variants.repair_words(spark.createDataFrame([("person", *w) for w in words + short] + [("other", "lozez", 1)], "space string, word string, n long")).collect()}
    assert got == {"sachochirga": "sachichirga", "zachochirga": "sachichirga", "cejegula": "cejegulla", "ruguttrondi": "rugutrondi", "lozez": "lopez", "gacria": "garcia", "riuz": "ruiz", "veg": "vega", "lopezruiz": "lopez ruiz", "иваонв": "иванов"}


def _members(spark, typed):
    spelled = variants.split_names(spark.createDataFrame([(t,) for t in typed], "name string"))
    out: dict = {}
    for r in entities.author_members(spelled).collect():
        out[r.key] = r.cluster
    return out


def _corpus(rng, letters, n):
    """Invented people of an alphabet, no name of which any list could hold: (given, given, surname, surname)."""
    word = lambda k: "".join(rng.choice(letters[i % 2]) for i in range(k))
    given, family = [word(rng.randint(4, 8)) for _ in range(25)], [word(rng.randint(4, 10)) for _ in range(60)]
    return [(*rng.sample(given, 2), *rng.sample(family, 2)) for _ in range(n)]


@pytest.mark.parametrize("letters", [("bcdfglmnprstvz", "aeiou"), ("бвгдзклмнпрст", "аеиоу")])
def test_held_out_spellings(spark, letters):
    """Recall and precision of links among unseen names with errors of up to two edits, in two scripts."""
    rng = random.Random(5)
    cap = str.capitalize

    def edit(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + rng.choice(letters[0]) + w[i + 1 :], w[: max(i - 1, 0)] + w[max(i - 1, 0) : i + 1][::-1] + w[i + 1 :]])

    truth = {}
    for k, (g, h, x, y) in enumerate(_corpus(rng, letters, 150)):
        plain = [f"{cap(x)} {cap(y)}, {cap(g)} {cap(h)}", f"{cap(g)} {cap(x)}-{cap(y)}", f"{cap(x)} {cap(y)}, {cap(g)} {cap(h[0])}.", f"{x} {y}, {g}".upper()]
        wrong = [f"{cap(edit(x))} {cap(y)}, {cap(g)}", f"{cap(x)} {cap(edit(y))}, {cap(g)} {cap(h)}", f"{cap(edit(x))} {cap(edit(y))}, {cap(g)} {cap(h)}", f"{cap(x)}{y}, {cap(g)}"]
        for t in plain + wrong:
            truth[t] = k
    got = _members(spark, truth)
    pairs = lambda of: {p for _, g in itertools.groupby(sorted(of, key=lambda t: str(of[t])), key=lambda t: of[t]) for p in itertools.combinations(sorted(g), 2)}
    want, found = pairs(truth), pairs(got)
    assert len(want & found) >= 0.9 * len(want) and len(want & found) >= 0.9 * len(found), (len(want), len(found), len(want & found))


def test_given_names_of_one_edit_and_short_forms(spark):
    """Daniel is not Daniela; a short form is learned from the surnames it shares with the full name; Nikolaus' sign names stay whole."""
    rng = random.Random(7)
    people = _corpus(rng, ("bcdfglmnprstvz", "aeiou"), 200)
    typed = [f"{x.capitalize()} {y.capitalize()}, {g.capitalize()}" for g, _, x, y in people]
    surnames = sorted({(x.capitalize(), y.capitalize()) for _, _, x, y in people})
    for i, (x, y) in enumerate(surnames[:80]):
        typed += [f"{x} {y}, {'Daniel' if i % 2 else 'Daniela'}"] + ([f"{x} {y}, Dani"] if i % 2 and i < 30 else [])
    got = _members(spark, [*typed, "Garcia Lopez, Daniel", "Garcia Lopez, Daniela", "王 伟", "王 芳"])
    assert got["Garcia Lopez, Daniel"] != got["Garcia Lopez, Daniela"] and got["王 伟"] != got["王 芳"]
    x, y = surnames[1]
    assert got[f"{x} {y}, Dani"] == got[f"{x} {y}, Daniel"]


def test_very_many_equal_surnames_end(spark):
    """A block of 50,000 names with one first surname: linear work, no comparison of all pairs."""
    rows = [(f"Garcia {'bcdfg'[i % 5]}{'aeiou'[i // 5 % 5]}{i}ez".replace(str(i), "".join("abcdefghij"[int(c)] for c in str(i))), "Maria") for i in range(50_000)]
    sigs = spark.createDataFrame([(names.signature([g.lower()], x.lower().split()), [g.lower()], x.lower().split(), 1) for x, g in rows] + [("m|garcia", ["m"], ["garcia"], 3)], "sig string, given array<string>, family array<string>, n long")
    links = variants.roots(variants.fuller_names(sigs)).collect()
    assert len(links) == 1 and variants.average_linkage(sigs.withColumn("label", F.col("sig"))).count() == 50_001


def test_average_clusters():
    pairs = [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.1), (3, 4, 0.6), (2, 3, -1.0)]
    group = lambda **k: sorted(map(sorted, variants.average_clusters([1.0] * 5, pairs, 0.5, **k)))
    assert group() == [[0, 1], [2], [3, 4]] and sorted(map(sorted, variants.average_clusters([1.0] * 5, pairs, 0.44))) == [[0, 1, 2], [3, 4]]
    assert sorted(map(sorted, variants.average_clusters([1.0] * 3, [(0, 1, 0.9), (1, 2, 0.8)], 0.5, absent=False))) == [[0, 1, 2]]


def test_kinds_of_organizations_are_learned(spark):
    """Heads of one kind meet over their letters and places, acronyms over what they are written beside, units drop out."""
    places = ["Rota", "Nerul", "Sabina", "Tolmar", "Vekka", "Lubago"]
    others = ["Rota", "Quibor", "Yanuk", "Dormes", "Zafira", "Pelusa", "Omtep"]
    typed = [f"{h} {p}" for p in places for h in ("Instituto Técnico de", "Inst. Téc.", "Technical Institute of", "Campus Sur, Instituto Técnico de")] + [f"{h} {p}" for p in others for h in ("Hospital General de", "Hosp. Gral.")]
    typed += ["Instituto Técnico de Rota (ITRO)", "ITRO", "I.T.R.O.", "Nerul, Instituto Técnico de", "ITSA"]
    got = {r.key: (r.kind, r.place) for r in organizations.organization_keys(spark.createDataFrame([(t,) for t in typed], "key string")).collect()}
    for p in places:
        assert len({got[f"{h} {p}"] for h in ("Instituto Técnico de", "Inst. Téc.", "Technical Institute of", "Campus Sur, Instituto Técnico de")}) == 1
    assert got["ITRO"] == got["I.T.R.O."] == got["Inst. Téc. Rota"] and got["Nerul, Instituto Técnico de"] == got["Inst. Téc. Nerul"] and got["ITSA"] == got["Inst. Téc. Sabina"]
    assert got["Hosp. Gral. Rota"] == got["Hospital General de Rota"] != got["Inst. Téc. Rota"]


def test_terms_against_plain_counts(spark):
    rows = [("a", ["Soil", "soil ", " SOIL\t use", None, ""]), ("b", ["Soil", "útil"]), ("c", ["útil", "Útil"]), ("d", None), ("e", [])]
    df = terms.normal_terms(spark.createDataFrame(rows, "id string, k array<string>"), ["k"])
    expected_n, expected_r = Counter(), Counter()
    for _, k in rows:
        clean = [" ".join(unicodedata.normalize("NFC", x).lower().replace(" ", " ").split()) for x in k or [] if x]
        expected_n.update(clean)
        expected_r.update(set(clean))
    got = {r.term: (r.n_occurrences, r.n_records) for r in terms.term_frequencies(df, ["k"]).collect()}
    assert got == {t: (expected_n[t], expected_r[t]) for t in expected_n}
    marked = {r.term: r.mark for r in terms.mark_terms(terms.term_frequencies(df, ["k"]), F.lit(5), 2, 0.3).collect()}
    assert marked == {"soil": "common", "soil use": "rare", "útil": "common"}


def test_pairs_against_plain_counts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(200)] + [(999, [f"x{i}" for i in range(300)])]
    count = Counter(p for _, k in rows for p in itertools.combinations(sorted(set(k)), 2))
    one = Counter(x for _, k in rows for x in set(k))
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab) for r in pairs.pair_counts(spark.createDataFrame(rows, "id long, k array<string>"), "id", ["k"], 3).collect()}
    assert got == {p: (one[p[0]], one[p[1]], n) for p, n in count.items() if n >= 3}


def test_all_pairs_are_reported(spark):
    """p4_pairs has no floor: pairs of one work and rare items count too."""
    got = {(r.field_name, r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab) for r in queries.QUERIES["p4_pairs"](spark, DATA).collect()}
    works = queries._current_terms(spark, DATA, queries._P4).collect()
    one, two = Counter(), Counter()
    for r in works:
        for f in queries._P4:
            items = sorted(set(r[f] or []))
            one.update((f, x) for x in items)
            two.update((f, *p) for p in itertools.combinations(items, 2))
    assert min(two.values()) == 1 and got == {(f, a, b): (one[f, a], one[f, b], n) for (f, a, b), n in two.items()}


def test_linkage_levels_and_estimation():
    assert linkage._family_level(["soto", "lara"], ["soto"]) == 2 and linkage._family_level(["soto", "lara"], ["soto", "vega"]) == 0 and linkage._family_level([], ["soto"]) == 1
    assert linkage._given_level(["ana", "luz"], ["a"]) == 1 and linkage._given_level(["ana"], ["eva"]) == 0 and linkage._given_level(["ana", "luz"], ["ana", "luz"]) == 4
    odds, tables = linkage.estimate({"34332": 500, "30010": 300, "04012": 200, "34111": 50, "21332": 40}, 400)
    assert odds["34332"] > 100 and odds["30010"] < 0.1 and odds["04012"] < 0.1 and linkage.estimate({}, 1.0)[0] == {}
    assert tables["given"][1][0] > 0.3 > tables["given"][0][0]  # both sides are estimated
    assert {round(sum(t), 6) for both in tables.values() for t in both} == {1.0}


def test_crowded_blocks_lose_no_agreeing_pair(spark, monkeypatch):
    people = [(str(i), ["ana"], ["soto", "lara"], [f"e{i % 7}"], ["1"], ["MX"]) for i in range(40)]
    left = spark.createDataFrame(people, "cvu string, given array<string>, family array<string>, r_employers array<string>, r_levels array<string>, r_countries array<string>")
    right = spark.createDataFrame([(f"p{i}", ["ana"], ["soto", "lara"], f"e{i % 7}" if i % 5 else None, None, None) for i in range(40)], "author_id string, given array<string>, family array<string>, p_employer string, p_level string, p_country string")
    assert linkage.candidates(left, right).count() == 1600
    monkeypatch.setattr(linkage, "CROWDED", 100)
    assert {(int(r.cvu) % 7, int(r.author_id[1:]) % 7) for r in linkage.candidates(left, right).collect()} == {(i, i) for i in range(7)}


def test_verified_matches_are_found(spark):
    """Held-out recall over all verified matches that lead to a profile, also those whose names share nothing."""
    base = DATA.replace("0.001", "0.01")
    found = {(r.cvu, r.author_id) for r in queries.QUERIES["p6_found"](spark, base).collect()}
    m = spark.read.parquet(f"{base}/snii_llm_verified_matches.parquet").select(registry_key(F.col("snii_cvu")).alias("cvu"), F.regexp_extract("matched_openalex_id", r"(A\d+)", 1).alias("pid")).join(spark.read.parquet(f"{base}/author_profiles.parquet").select(F.col("id").alias("pid")).distinct(), "pid").where(F.col("cvu").isNotNull()).distinct()
    pairs = [(r.cvu, r.pid) for r in m.collect()]
    assert pairs and sum(p in found for p in pairs) >= 0.85 * len(pairs)


def test_very_common_complete_names_all_meet(spark):
    """Every pair of profiles of one complete name is compared, also where 230 have it and no attribute agrees."""
    rows = [(f"p{i:03d}", ["ana"], ["soto", "lara"], "ana|soto lara", None, f"topic{i}", "MX", None, f"e{i}", True) for i in range(230)]
    people = spark.createDataFrame(rows, "id string, given array<string>, family array<string>, sig string, orcid string, topic string, country string, level string, employer string, complete boolean")
    pairs = entities.candidate_pairs(people)
    assert pairs.count() == pairs.where("a < b").distinct().count() == 230 * 229 // 2


def test_families_of_many_given_names_count_for_aliases(spark):
    """A short form is learned from surnames with 60 given names too; where everybody has every name, there is nothing to learn."""
    rng = random.Random(1)
    vocabulary = [f"name{i:04d}" for i in range(3000)]
    rows = [([g], [f"small{f}", "other"]) for f in range(3000) for g in rng.sample(vocabulary, 2)]
    for f in range(12):
        rows += [([g], [f"large{f}", "other"]) for g in {*rng.sample(vocabulary, 58), "francisco", *(["paco"] if f < 6 else [])}]
    parsed = "given array<string>, family array<string>"
    assert {r.alias: r.name for r in variants.given_aliases(spark.createDataFrame(rows, parsed)).collect()}["paco"] == "francisco"
    full = [([f"given{g:02d}"], [f"same{f}", "other"]) for f in range(20) for g in range(60) if g or f < 16]
    assert variants.given_aliases(spark.createDataFrame(full, parsed)).count() == 0


def test_words_are_compared_in_every_size_of_their_grams(spark):
    """Words of five and six letters have two vectors; a pair that reaches the threshold with either is found with it."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 6))) for _ in range(60)})
    vectors = variants.word_vectors(spark.createDataFrame([("person", w, 1) for w in words], "space string, word string, n long"))
    weights = sparse.feature_weights(vectors)
    a, b = F.col("a"), F.col("b")
    met = sparse.cosine_join(vectors, vectors, weights, 0.4, a["size"] - b["size"] == 0, lambda x: sparse.gram_features(F.col(f"{x}.id"), F.col(f"{x}.size"), F.col(f"{x}.space")))
    vector = {(r.id, r["size"]): {f: float(weights[f]) ** 2 for f in r.features} for r in vectors.collect()}
    want = set()
    for (v, k), (w, m) in itertools.permutations(vector, 2):
        x, y = vector[v, k], vector[w, m]
        if k == m and sum(x[f] for f in x if f in y) >= 0.4 * (sum(x.values()) * sum(y.values())) ** 0.5:
            want.add((v, w, k))
    assert {(r.a.id, r.b.id, r.a["size"]) for r in met.collect()} == want and {2, 3} == {k for *_, k in want}


def test_close_names_meet_without_postings(spark, monkeypatch):
    """Names that differ in one surname meet in what they have in common; nothing is posted and only close pairs get vectors."""
    monkeypatch.setattr(sparse, "posted", lambda *_: pytest.fail("posted"))
    rows = [("ana", "garcia", "sachichirga", 8), ("ana", "garcia", "sachochirga", 1), ("ana", "garcia", "sachichirgo", 5), ("ana", "garcio", "sachichirga", 2), ("eva", "garcia", "sachochirga", 1), ("ana", "garcia", "vega", 1), ("ana", "garcia", "vego", 9)]
    sigs = spark.createDataFrame([(names.signature([g], [x, y]), [g], [x, y], n) for g, x, y, n in rows], "sig string, given array<string>, family array<string>, n long")
    got = {(r.a, r.b) for r in variants.close_names(sigs).collect()}
    assert got == {("ana|garcia sachochirga", "ana|garcia sachichirga"), ("ana|garcio sachichirga", "ana|garcia sachichirga")}


def test_words_one_edit_apart_meet_without_postings(spark, monkeypatch):
    """Slips of one edit meet by equality after leaving out a letter; only words that may be two edits apart are posted."""
    posted = sparse.posted
    seen: list[str] = []

    def watched(df, weights):
        seen.extend(r.id for r in df.select("id").collect())
        return posted(df, weights)

    monkeypatch.setattr(sparse, "posted", watched)
    rng = random.Random(4)
    common = sorted({"".join(rng.choice("abcdefgimnorst") for _ in range(rng.randint(4, 11))) for _ in range(40)})
    slip = {}
    for w in common:
        for kind in range(4):
            i = rng.randrange(len(w) - 1)
            v = (w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[kind]
            if len(v) >= 3 and v not in common:
                slip[v] = w
    words = spark.createDataFrame([("person", w, 40) for w in common] + [("person", v, 1) for v in slip] + [("other", common[0][:-1] + "x", 1)], "space string, word string, n long")
    met = {(r.a.id, r.b.id) for r in variants.near_words(words).collect()}
    assert met >= set(slip.items()) and all(names.near(v, w) or (len(v) == len(w) and set(v) == set(w)) for v, w in met)
    got = {r.word: r.fixed for r in variants.slips(words).collect()}
    assert set(got) <= set(slip) and sum(got.get(v) == w for v, w in slip.items()) >= 0.9 * len(slip)
    assert seen and all(len(w) >= variants.FAR_LENGTH for w in seen)


def test_sides_unique_by_key_are_hashed_where_they_lie(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "node string, size double")
    edges = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, weight double")
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    found = variants.linkage_groups(nodes, edges, labels, 0.5)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan  # a broadcast would pass through the driver


def test_lists_of_columns():
    rows = [["a"], [], ["b", "c"], ["d"]]
    assert names.lists(names.list_array(rows, pa.string()).slice(1, 2)) == rows[1:3]
    assert names.values(pa.array(["x", None, "é"])) == ["x", None, "é"] and names.values(pa.array([3, 4])) == [3, 4] and names.values(pa.array([], pa.string())) == []
