"""Search, classifiers, surrogates, and the pipeline."""

import re
import time
import zlib

import numpy as np

from barloom.llm import ann, pii, quality, toxicity
from barloom.llm.common import is_held_out


def brute(pairs, k, every=20):
    pairs = sorted(pairs, key=lambda p: p[0])
    ids = np.array([p[0] for p in pairs])
    x = np.array([p[1] for p in pairs], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = [int(v) for v in ids[keep][order]]
    return out


def test_neighbours_recall(spark):
    for folder in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
        want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
        got = {}
        for r in ann.inner_product_neighbours(df).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert set(got) == set(want)
        assert all(sorted(n for n, _ in g) == list(range(1, 21)) for g in got.values())
        hit = sum(len(set(want[q]) & {v for _, v in got[q]}) for q in want)
        assert hit >= 0.95 * 20 * len(want)


def test_neighbours_recall_with_many_more_lists_than_probes(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = {}
    for r in ann.inner_product_neighbours(df, probes=3, list_size=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(g) == 20 for g in got.values())
    assert sum(len(set(want[q]) & got[q]) for q in want) >= 0.95 * 20 * len(want)


def test_threshold_scan_keeps_all_within_the_threshold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 65)), rng.standard_normal((40, 65))
    d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    worst, allowed = np.partition(d, 20, axis=1)[:, 20], rng.random(d.shape) < 0.7
    left = ann.threshold_scan(q, x, worst, allowed)
    true = [set(np.flatnonzero(row & ok)) for row, ok in zip(d <= worst[:, None], allowed, strict=True)]
    assert all(set(a) <= t for a, t in zip(left, true, strict=True))
    assert sum(map(len, left)) >= 0.95 * sum(map(len, true))


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (64, [1.0, float("inf"), 0.0]), (65, []), (None, [1.0, 1.0, 1.0]), (66, [1.0, 2.0]), (7, [1.0, 1.0, 0.5]), (80, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 0, 1.0) for a, b in rows], "vec_id long, embedding array<float>, ids int, score double")
    got = {}
    for r in sorted(ann.inner_product_neighbours(df).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute([(i, v) for i, v in rows[:60]], 20)
    assert ann.inner_product_neighbours(df.limit(0)).count() == 0
    few = ann.inner_product_neighbours(df.filter("vec_id < 3"))
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 2)]


def held(df, labels, spark):
    return df.join(labels, "doc_id").filter(is_held_out(df.doc_id)).toPandas()


def test_toxicity(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count()
    t = held(out, labels, spark)
    assert t.predicted[t.toxic == 1].mean() > 0.9 and t.predicted[t.toxic == 0].mean() < 0.02
    lexicon = toxicity.fit(docs, labels)
    assert toxicity.score(odd, lexicon).count() == odd.count()
    assert toxicity.score(nothing, lexicon).count() == 0
    hidden = spark.createDataFrame([(1, "the 1d10t of it"), (2, "the idiоt"), (3, "of the and"), (4, "you st​upid")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(hidden, lexicon).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}


def slow_toxicity(given):
    """The lexicon of (text, t) by plain counting, and each text's score by the definition."""
    n1 = sum(t for _, t in given)
    n0 = len(given) - n1

    def counts(keys):
        found = {}
        for text, t in given:
            for key in keys(text):
                found.setdefault(key, [0, 0])[1 - t] += 1
        return found

    entries = toxicity.chosen_entries([(k, a, b) for k, (a, b) in sorted(counts(toxicity.pieces).items()) if a >= 4], n1, n0)

    def places(text, phrases):
        return [(i, p) for p in phrases for i in range(len(text)) if text.startswith(p, i)]

    def around(text):
        text = toxicity.folded(text)
        words = text.split(" ")
        out = set()
        for i, p in places(text, entries):
            k = text[: i + 1].count(" ")
            if k > 1:
                out.add(f" {words[k - 1]} {words[k]} ")
            if k + 1 < len(words) - 1:
                out.add(f" {words[k]} {words[k + 1]} ")
        return out

    spares = {p for p, (a, b) in counts(around).items() if b >= 4 and b / n0 > 4 * (a + 0.5) / n1}

    def measured(text):
        text = toxicity.folded(text)
        inside = {j for i, p in places(text, spares) for j in range(i, i + len(p) - 1)}
        best = {}
        for i, p in places(text, entries):
            best[i] = max(best.get(i, 0), entries[p])
        total = sum(w for i, w in best.items() if i not in inside)
        return np.log1p(total), np.log1p(100 * total / (max(1, len(text.split())) + 50))

    return entries, spares, measured


def test_toxicity_by_brute_force(spark):
    rng = np.random.default_rng(4)
    calm = [f"calm{i}" for i in range(30)]
    given = []
    for i in range(260):
        words = list(rng.choice(calm, 12))
        if i < 60:
            words[int(rng.integers(12))] = ("vile", "vileness", "rotten")[i % 3]
        elif i < 70:
            at = int(rng.integers(11))
            words[at : at + 2] = ["rotten", "apples"]
        given.append((" ".join(words), int(i < 60)))
    entries, spares, measured = slow_toxicity(given)
    lexicon = toxicity.learn(spark.createDataFrame(given, "text string, t int"))
    assert lexicon.entries == entries and set(lexicon.exceptions) == spares and spares
    own = lexicon.automaton()
    for text, _ in [*given, ("rotten apples rotten vile", 1), ("", 0)]:
        assert np.allclose(toxicity.measures(text, own), measured(text))
    one = toxicity.learn(spark.createDataFrame(given[:5], "text string, t int"))
    assert one.entries == {} and one.coefficients[0] > 0


def test_toxicity_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0}, {" trash day ": 1.0})
    assert toxicity.measures("take trash day", lexicon.automaton())[0] == 0
    assert toxicity.measures("trash day trash", lexicon.automaton())[0] > 0
    start = time.process_time()
    toxicity.measures("trash trash day " * 100_000, lexicon.automaton())
    assert time.process_time() - start < 10


def test_toxicity_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 5


def test_quality(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    t = held(quality.quality(docs, labels), labels, spark)
    assert (t.predicted == t.quality).mean() > 0.97
    assert t.predicted[t.quality == 1].mean() > 0.99
    full = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "cast(null as long) n_chars", "key score")
    model = quality.fit(docs, labels)
    assert quality.score(full, model).count() == odd.count()
    assert quality.kept_by_quality(full, model).columns == full.columns
    assert quality.score(full.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).scores([np.zeros((1, len(quality.text_features("")))), np.zeros((1, quality.METADATA_SLOTS + 8))])[0] > 0.9


def test_quality_pool_is_the_whole_table(spark):
    """Sources outside any sample reach scaling and rounds; the stored pool picks what one in memory does."""
    rows = [(i, "good calm words here " * 9 + str(i % 7) if i % 2 else "!!! $$ BUY ### " * 9 + str(i % 5), "en", "a" if i % 2 else "b", 200) for i in range(600)]
    rows += [(i, "good calm words here " * 7 + str(i % 9), "xx", "rare", 150) for i in range(600, 640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels, pool=8)
    known = [i for i in range(120) if not zlib.crc32(str(i).encode()) % 4 == 2]
    used = [r for r in rows if r[0] in known or r[0] >= 120]
    every = quality._views([r[1] for r in used], [r[2:] for r in used])
    for (mean, spread), x in zip(model.scale, every, strict=True):
        assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, np.maximum(x.std(axis=0), 1e-3), atol=1e-6)
    whole = quality.fit(docs, labels)
    pick = lambda rs: quality._views([r[1] for r in rs], [r[2:] for r in rs])
    fitted = [r for r in rows if r[0] in known]
    memory = quality.co_train(pick(fitted), np.array([r[0] % 2 for r in fitted]), pick(rows[120:]))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole.models, memory.models, strict=True))


def luhn(digits):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark, odd, nothing):
    rows = [
        (1, "Mail Bob.Smith@Mail4.Example.com or bob.smith@mail4.example.com, call +1 (017) 555-7713 or +1 017 555 7713."),
        (2, "Card 4111 1111 1111 1111, 4111111111111111; not 1234567890123456."),
        (3, "Frau Anna Berg und Herr Berg. Госпожа Анна Иванова. 192.168.4.7 8.8.8.8 version 3."),
        (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f9"'),
        (5, None),
        (6, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.surrogate_report(df).collect()}
    one = re.search(r"Mail (\S+) or (\S+), call (\+1 \((\d{3})\) (\d{3})-(\d{4})) or \+1 (\d{3}) (\d{3}) (\d{4})\.", out[1].text)
    assert one and one[1].lower() == one[2] and one.group(4, 5, 6) == one.group(7, 8, 9) and one[1] != "Bob.Smith@Mail4.Example.com"
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{4}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", one[1])
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}), (\d{16}); not 1234567890123456\.", out[2].text)
    assert card and card[1].replace(" ", "") == card[2] != "4111111111111111" and luhn(card[2]) and card[2][0] == "4"
    names = re.search(r"Frau (\w+na) (\w+) und Herr (\w+)\. Госпожа ([а-яА-Я]+на) ([а-яА-Я]+ва)\. 192\.168\.\d+\.\d+ (\d+)\.\d+\.\d+\.\d+ version 3\.", out[3].text)
    assert names and names[2] == names[3] != "Berg"
    assert re.fullmatch('token = "[0-9a-f]{38}"', out[4].text) and "04dbebab" not in out[4].text
    assert out[5].text is None and out[6].text == "" and out[5].n_entities == 0
    assert {r.doc_id: r.text for r in pii.surrogate_report(df, "other").collect()}[1] != out[1].text
    assert pii.without_personal_data(odd).collect() == odd.collect()
    assert pii.surrogate_report(nothing).count() == 0


def test_surrogates_replace_whole_tokens(spark):
    rng = np.random.default_rng(5)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"))
    draw = lambda n: "".join(rng.choice(alphabet, n - 1)) + "x"
    long, jwt, padded, many = draw(1000), f"{draw(36)}.{draw(300)}.{draw(43)}", draw(42) + "==", draw(20) + ".ab" * 5000
    label = "a" * 63
    mail = f"bob@{label}.{'b' * 50}.one.two.three.four.photography"
    tokens = [long, jwt, padded, many, "A" * 1000]
    rows = [(i, f"token = {t}. Then") for i, t in enumerate(tokens)] + [(9, f"from {mail}.")]
    out = {r.doc_id: r for r in pii.surrogate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, old in enumerate(tokens):
        new = re.fullmatch(r"token = (.*)\. Then", out[i].text)[1]
        assert len(new) == len(old) and out[i].n_entities == 1
        assert all((a == b) if b in "._-=" else a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(new, old, strict=True))
        pieces = re.findall(r"[A-Za-z0-9]{8}", old)
        assert i == 4 or not any(p in new for p in pieces)
    repeated = out[4].text[8:-6]
    assert len({repeated[k : k + 20] for k in range(len(repeated) - 20)}) == len(repeated) - 20
    new = re.fullmatch(r"from (.*)\.", out[9].text)[1]
    assert len(new) == len(mail) and new.endswith(".photography") and not {label, "b" * 50, "three"} & set(re.split("[.@]", new))


def test_surrogates_are_distinct(spark):
    """Short atoms collide at first; the checks draw again, by literal and by join."""
    rows = [(i, f"Ms Ab{chr(97 + i % 26)}{chr(97 + i // 26)} wrote {chr(97 + i % 26)}{i // 26}@a.de from 10.0.0.{i + 1}") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_entities(df)
    first = pii.redrawn(found, rounds=20).count()
    assert first > 0
    texts = [r.text for r in pii.surrogate_report(df).collect()]
    pattern = re.compile(r"Ms (\w+) wrote (\S+) from (\S+)")
    parts = list(zip(*(pattern.fullmatch(t).groups() for t in texts), strict=True))
    assert all(len(set(p)) == 250 for p in parts)
    most, pii.MOST_LITERAL = pii.MOST_LITERAL, 0
    try:
        assert sorted(r.text for r in pii.surrogate_report(df).collect()) == sorted(texts)
    finally:
        pii.MOST_LITERAL = most


def test_surrogates_of_longer_names(spark):
    rows = [(1, "Mr John Ronald Reuel Tolkien wrote. Ms Tolkien-Smith too; MR JOHN TOLKIEN."), (2, "Mrs " + "Anna " * 20_000 + "end")]
    out = {r.doc_id: r.text for r in pii.surrogate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = re.fullmatch(r"Mr (\w+n) (\w+n) (\w+n) (\w+s) wrote\. Ms (\w+s) too; MR JOHN TOLKIEN\.", out[1])
    assert found and not {"John", "Ronald", "Reuel", "Tolkien"} & set(found.groups())
    assert "Anna" not in out[2] and out[2].endswith(" end") and len(set(out[2].split()[1:-2])) == 1


def test_surrogates_where_a_format_is_used_up(spark):
    """Every private address, all short mailboxes: distinct surrogates, none in its place."""
    rows = [(i, f"192.168.{i // 256}.{i % 256}") for i in range(1 << 16)] + [(70_000 + i, f"{a}@{b}.de") for i, (a, b) in enumerate((chr(97 + x), chr(97 + y)) for x in range(26) for y in range(26))]
    out = [(r.doc_id, r.text) for r in pii.surrogate_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()]
    given = dict(rows)
    ips = [t for i, t in out if i < 70_000]
    assert len(set(ips)) == 1 << 16 and set(ips) == {t for i, t in rows if i < 70_000}
    mails = [t for i, t in out if i >= 70_000]
    assert len(set(mails)) == 676 and not set(mails) & {t for i, t in rows if i >= 70_000}
    assert all(t != given[i] for i, t in out)


def test_permutations(spark):
    every = [f"{i:04}" for i in range(10_000)]
    atoms = [("phone", "49+49" + d, 0) for d in every] + [("card", f"4{d}0", 0) for d in every] + [("ip", f"10.{i // 256}.{i % 256}.7", 0) for i in range(2000)]
    df = spark.createDataFrame(atoms, "kind string, canon string, x int").selectExpr("*", f"{pii._moved('kind', 'canon', 'k')} AS moved")
    got = {}
    for r in df.collect():
        assert r.moved != r.canon.rpartition("+")[2]
        got.setdefault(r.kind, set()).add(r.moved)
        if r.kind == "card":
            assert luhn(r.moved) and r.moved[0] == "4"
    assert {k: len(v) for k, v in got.items()} == {"phone": 10_000, "card": 10_000, "ip": 2000}


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    out = corpus_pipeline.run(spark, small).toPandas()
    assert 0 < out.doc_id.nunique() <= docs.count()
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def documents_of(rows, spark):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string, __key long, __intervals string, __entities int, __attempts int, __go int")


def test_stages_on_odd_documents(spark, small):
    """Nulls in every column, empty and long texts, repeats, clashing names, and no rows."""
    import corpus_pipeline

    base = " ".join(f"word{i}" for i in range(80))
    more = ("i", 5, "v", 6, 7, 8)
    rows = [(1, base, "en", "a", 500, *more), (1, base, "en", "a", 500, *more), (2, base + " tail", "en", "a", 505, *more), (3, None, None, None, None, *([None] * 6)), (4, "", "en", "a", 0, *more), (None, "write to bob@b.de", "en", None, 9, *more), (None, "write to bob@b.de", "en", None, 9, *more), (5, " ".join(f"long{i % 977}" for i in range(30_000)), "de", "b", -1, *more), (6, "Mr Bob Smith, bob@b.de", "xx", "", 3, *more)]
    docs = documents_of(rows, spark)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, small)
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), small).count() == 0
        got = out.collect()
        assert all(r["__id"] in ("i", None) and r["__entities"] in (6, None) for r in got)
        if name == "near duplicates":
            assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 3, 4, 5, 6]
        elif name == "repeated passages":
            assert len(got) == 9 and sorted(r.text for r in got if r.doc_id in (1, 2)) == ["", "", "tail"]
        elif name == "personal data":
            mails = {r.text.split()[-1] for r in got if r.doc_id in (None, 6)}
            assert len(got) == 9 and len(mails) == 1 and "bob@b.de" not in mails
        else:
            assert 0 < len(got) <= 9 and len([r for r in got if r.doc_id == 1]) in (0, 2)
    packed = stages["packing"](spark, docs, small)
    assert packed.filter("doc_id is null").count() == 2 and packed.filter("doc_id in (3, 4)").collect()[0].length == 1
    assert stages["packing"](spark, docs.limit(0), small).count() == 0

