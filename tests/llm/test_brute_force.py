"""Operators and the pipeline against plain Python on small tables, and the results of odd rows."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slideloom.llm import decontaminate, langid, license_scan, mixing, neardup, pii, quality, queries, substring, tokens

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# -- repeated passages ---------------------------------------------------------------------------------------


def sentences(text):
    """Words of each sentence: up to a word that ends in . ! ?, a line break or the end."""
    out = []
    for line in (text or "").split("\n"):
        now = []
        for w in words(line):
            now.append(lower(w))
            if w[-1] in ".!?":
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


def all_runs(s, run_words, long_words):
    """Every run of two or more sentences with enough words, and every single sentence with enough."""
    sizes = [len(x) for x in s]
    return [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if sum(sizes[a:b]) >= (run_words if b - a > 1 else long_words)]


@pytest.mark.parametrize("floors", [(substring.RUN_WORDS, substring.LONG_WORDS), (0, 10**6), (25, 50)])
def test_repeats_match_brute_force(spark, floors):
    rng = random.Random(4)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.choice([1, 3, 8, 14, 20, 55]))) + rng.choice([".", "!", "?", "\n"]) for _ in range(16)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(40)] + [None, "", "one", " ".join(pool[:6] * 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in (substring.drop_repeats(docs) if floors[0] == substring.RUN_WORDS else substring.drop_repeats(docs, *floors)).collect()}
    seen, removed = {}, defaultdict(set)
    for i, t in enumerate(texts):
        s = sentences(t)
        for a, b in sorted(all_runs(s, *floors)):  # the first place of each run, then all that are not the first
            if seen.setdefault(tuple(sum(s[a:b], [])), (i, a)) != (i, a):
                removed[i] |= set(range(a, b))
    for i, t in enumerate(texts):
        s = sentences(t)
        assert (got[i].n_sentences, got[i].n_removed, got[i].n_removed_words) == (len(s), len(removed[i]), sum(len(s[k]) for k in removed[i])), i
        assert [lower(w) for w in words(got[i].text)] == sum((x for k, x in enumerate(s) if k not in removed[i]), [])
    assert sum(map(len, removed.values())) > 20


# -- personal data -------------------------------------------------------------------------------------------


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        check = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        out += [("card", m.start(), m.end())] * (13 <= len(digits) <= 19 and check % 10 == 0)
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_personal_data_matches_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["@", ".", "a", "b@c.de", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "+1 (212) 555-0100", "+49 30 1234567", " ", "-", "7", "12", "é", "@x.y", "%", "\n", "0000", "."]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(400)] + [None, "", "+1", "1" * 30_000]
    got = {r.doc_id: r for r in pii.detect_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS], t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i].spans.split(",")) | {""}


# -- language ------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    judged = [r for r in got.where("held_out AND lang IS NOT NULL").collect() if any(c.isalpha() for c in r.text or "")]
    assert len(judged) > 20 and sum(r.lang_pred == r.lang for r in judged) >= 0.95 * len(judged)


# -- odd rows ------------------------------------------------------------------------------------------------


def test_odd_rows_have_defined_results(spark):
    """Nulls in every column, repeated rows, ties and columns with the names of results."""
    schema = DOCUMENTS + ", kept string, score string, spans string, licenses string, tokens string, n_tokens string, n_removed string, component_id string, items string, weight string"
    clash = ["clash"] * 10
    long_text = "plain words in a row that say little. " * 9
    rows = [(None, long_text, None, None, None, *clash), (1, None, None, "s", None, *clash), (1, None, None, "s", None, *clash), (2, long_text, "en", "s", 1, *clash), (2, long_text, "en", "s", 1, *clash), (3, "", "en", None, 0, *clash)]
    docs = spark.createDataFrame(rows, schema)
    no_items = spark.createDataFrame([], "item_id long, text string")
    results = {
        "repeats": substring.drop_repeats(docs), "near": neardup.near_duplicates(docs), "tokens": tokens.count_tokens(docs), "mix": mixing.mix_sources(docs), "quality": quality.apply_quality_rules(docs),
        "license": license_scan.scan_licenses(docs), "pii": pii.detect_pii(docs), "language": langid.identify(docs, langid.train(docs)), "clean": decontaminate.find_contamination(docs, no_items),
    }
    got = {name: sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)) for name, df in results.items()}
    for name, out in got.items():
        assert [r.doc_id for r in out] == [None, 1, 1, 2, 2, 3], name
        assert out[1] == out[2] and out[3] == out[4], name
    assert [r.n_removed for r in got["repeats"]][1:3] == [0, 0] and got["repeats"][0].text != got["repeats"][3].text
    assert [r.component_id for r in got["near"]] == [None, 1, 1, 2, 2, 3] and all(r.kept for r in got["near"])
    assert got["tokens"][1].n_tokens == 0 and got["mix"][1].tokens == 0 and not got["mix"][1].kept
    assert got["license"][1].licenses == [] and got["pii"][1].spans == "" and got["language"][1].lang_pred == "und"
    assert all((r.n_hit, r.contaminated) == (0, False) for r in got["clean"])
    assert got["quality"][1].base_failed and not got["quality"][1].kept


# -- the pipeline --------------------------------------------------------------------------------------------

ENGLISH = "the a house garden with walked over under river stone people said morning would have little great under their which never".split()
GERMAN = "der die das haus garten mit ging über unter fluss stein leute sagten morgen würde haben klein groß ihre welche niemals".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda own, k: " ".join(rng.choices(own, k=k))
    item = say(ENGLISH, 14)
    rows = []
    for i in range(60):
        own, lang = (ENGLISH, "en") if i % 3 else (GERMAN, "de")
        rows.append([i, say(own, rng.randrange(30, 120)), lang if i % 7 else None, f"s{min(i % 5, 2)}" if i % 11 else None, 0])
    for i in range(60, 75):  # near copies, a word apart
        w = rows[i - 50][1].split()
        w[rng.randrange(len(w) // 2)] = "changed"
        rows.append([i, " ".join(w), rows[i - 50][2], "s0", 0])
    rows += [[75, rows[5][1], "en", "s1", 0], [76, f"{say(ENGLISH, 40)} {item} {say(ENGLISH, 20)}", "en", "s1", 0], [77, None, "en", "s1", 0], [78, "12 34 !!", None, "s1", 0]]
    rows += [[79, f"{say(ENGLISH, 40)} write to jane.doe@example.org or 10.1.2.3 now {say(ENGLISH, 30)}", "en", "s2", 0]]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([("b1", item), ("b2", None)], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def near_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def water_level(have, target, budget):
    """The level at which values that have enough tokens make up for those that give all they have."""
    level, full = budget, set()
    while True:
        now = {v for v in have if have[v] <= level * target[v]}
        if now == full:
            return {v: min(have[v], level * target[v]) for v in have}
        full = now
        rest = sum(target[v] for v in have if v not in full)
        level = (budget - sum(have[v] for v in full)) / rest if rest > 0 else level


def chances(cells, powers, budget):
    """The probability of every cell by raking, in plain Python."""
    goals, factor = [], []
    for at, power in enumerate(powers.values()):
        have = defaultdict(int)
        for cell, n in cells.items():
            have[cell[at]] += n
        soft = {v: n**power for v, n in have.items()}
        goal = water_level(have, {v: x / sum(soft.values()) for v, x in soft.items()}, budget * sum(have.values()))
        goals.append(goal)
        factor.append({v: mixing.FULL if goal[v] >= have[v] else 1.0 if at else budget for v in have})
    weight = lambda cell: math.prod(f[v] for f, v in zip(factor, cell, strict=True))
    for _ in range(mixing.ROUNDS):
        gap = 0.0
        for at in range(len(powers)):
            step = {}
            for v, goal in goals[at].items():
                own = [(n, weight(cell)) for cell, n in cells.items() if cell[at] == v]
                reached, full, opened = sum(n * min(1, w) for n, w in own), sum(n for n, w in own if w >= 1), sum(n * w for n, w in own if w < 1)
                step[v] = goal / reached if goal < reached else (goal - full) / opened if opened > 0 else 1.0
                gap = max(gap, abs(goal - reached))
            factor[at] = {v: f * step[v] for v, f in factor[at].items()}
        if gap <= mixing.TOLERANCE * sum(goals[0].values()):
            break
    return {cell: min(1.0, weight(cell)) if n else 0.0 for cell, n in cells.items()}


def mixture(rows):
    """doc_ids that stay: raked cells, then a hash of doc_id against the cell's probability."""
    cells = defaultdict(int)
    for r in rows:
        cells[tuple(r[d] for d in mixing.POWERS)] += len(words(r["text"]))
    chance = chances(cells, mixing.POWERS, mixing.BUDGET)
    keep = set()
    for r in rows:
        p = chance[tuple(r[d] for d in mixing.POWERS)]
        drawn = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert abs(drawn - p) > 1e-9
        keep |= {r["doc_id"]} if drawn < p else set()
    return keep


def test_expected_and_drawn_margins_meet_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(20, 60), rng.choices(["a", "b", "c"], [60, 30, 10])[0], rng.choices(["en", "de"], [4, 1])[0], rng.choice(["x", "y"])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    wanted = {"source": {"a": 0.45, "b": 0.37, "c": 0.18}, "lang": {"en": 0.72, "de": 0.28}}
    targets = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in wanted.items()}
    got = mixing.margin_report(mixing.mix_sources(docs, targets=targets, budget=0.5), targets=targets, budget=0.5).collect()
    total = 0.5 * sum(r.have for r in got if r.dim == "source")
    for r in got:
        goal = wanted[r.dim][r.value] * total if r.dim in wanted else r.target * total
        assert math.isclose(r.goal, goal, rel_tol=1e-9) and math.isclose(r.expected, goal, rel_tol=1e-3) and math.isclose(r.drawn, goal, rel_tol=0.08), r
    # c has too little for half of the sample: it gives all it has, the others make up for it in their proportions
    short = {"source": spark.createDataFrame([("a", 0.3), ("b", 0.2), ("c", 0.5)], "source string, target double")}
    got = {(r.dim, r.value): r for r in mixing.margin_report(mixing.mix_sources(docs, targets=short, budget=0.5), targets=short, budget=0.5).collect()}
    a, b, c = (got["source", v] for v in "abc")
    assert c.goal == c.have == c.drawn and math.isclose(a.goal / b.goal, 1.5) and math.isclose(a.goal + b.goal + c.goal, total)
    assert all(math.isclose(r.expected, r.goal, rel_tol=1e-3) for r in got.values())


def test_cells_over_several_tasks_rake_alike(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice("abcdefg"), rng.choices(["en", "de", None], [4, 1, 1])[0], rng.choice("xyz")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    one = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_TASK", 10)
    several = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert len(one) == len(several) == 600 and all(one[i].kept == r.kept and math.isclose(one[i].probability, r.probability, rel_tol=1e-9) for i, r in several.items())
    cells = defaultdict(int)
    for r in rows:
        cells[r[2:]] += len(words(r[1]))
    chance = chances(cells, mixing.POWERS, mixing.BUDGET)
    assert all(math.isclose(one[r[0]].probability, chance[r[2:]], rel_tol=1e-9) for r in rows)


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    after, tables = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf_dir}/{name}")
        tables[name], docs = docs, spark.read.parquet(f"{sf_dir}/{name}")
        after[name] = {r.doc_id: r for r in docs.collect()}
    # no letters, no language; the others stay and get the language they are written in
    assert set(after["language_id"]) == set(before) - {77, 78}
    assert all(r.lang == ("de" if "der" in words(r.text) or "das" in words(r.text) or "garten" in words(r.text) else "en") for r in after["language_id"].values())
    groups = near_groups({i: r.text for i, r in after["language_id"].items()})
    assert set(after["near_dedup"]) == {i for i, g in groups.items() if i == g} and len(after["near_dedup"]) < len(groups) - 10
    item = words(spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 'b1'").first().text)
    windows = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    met = {i for i, r in after["near_dedup"].items() if windows(words(r.text)) & windows(item)}
    assert met == {76} and set(after["decontamination"]) == set(after["near_dedup"]) - met
    assert set(after["pii"]) == set(after["decontamination"])
    for i, r in after["decontamination"].items():
        want = pii.redact(r.text, plain_spans(r.text))
        assert after["pii"][i].text == want and after["pii"][i].n_chars == len(want)
    assert "[EMAIL]" in after["pii"][79].text and "[IP]" in after["pii"][79].text
    described = tables["mixing"].select("doc_id", "text", "source", "lang", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert set(after["mixing"]) == mixture(described)
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r for r in run.collect()} == after["mixing"]


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
