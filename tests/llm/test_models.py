"""Language, toxicity and decontamination: held-out accuracy, brute force and odd rows."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, language, toxicity

ODD = [(None, "no id at all"), (1, None), (2, ""), (3, "12 34 !!"), (4, "x"), (5, "The words the and of. " * 5000), (5, "again the same id")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(0))


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op5_language_id(spark, data).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    filters = language.fit(spark.createDataFrame([(1, "the and of the words", "en"), (2, "und der die das ist", "de")] * 5, "doc_id long, text string, lang string"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(odd(spark), filters).collect()]
    assert len(got) == len(ODD)
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en")} <= set(got)
    kept = language.with_language_only(odd(spark), filters)
    assert kept.columns == odd(spark).columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["4", "5", "5", "None"]
    nothing = language.fit(odd(spark).limit(0))
    assert language.with_language_only(odd(spark), nothing).count() == 4
    assert {r["lang_pred"] for r in language.identify(odd(spark), nothing).collect()} == {"und"}


def test_bit_masks_hold_every_member():
    import numpy as np

    grams = np.arange(5000, dtype=np.uint32) * 7919
    f = language.Filters({"a": grams[:3000], "b": grams[2000:]})
    for bit, own in ((0, grams[:3000]), (1, grams[2000:])):
        masks = f.masks[0][f.places(own)[0]] & f.masks[0][f.places(own)[1]] & f.masks[0][f.places(own)[2]]
        assert (masks >> np.uint64(bit) & np.uint64(1)).all()


def test_shares_against_plain_filters():
    """The masks against one plain Bloom filter for each of 70 languages, counted n-gram by n-gram."""
    import numpy as np

    rng = np.random.RandomState(3)
    words = ["".join(chr(97 + x) for x in rng.randint(0, 26, 6)) for _ in range(700)]
    members = {f"l{i:02d}": np.unique(np.concatenate([language.byte_grams(w) for w in words[10 * i : 10 * i + 30]])) for i in range(70)}
    f = language.Filters(members)
    plain = {}
    for lang, grams in members.items():
        plain[lang] = set()
        for place in f.places(grams):
            plain[lang].update(place.tolist())
    text = " ".join(words[100:140]) + " 123 " + " ".join(words[:3])
    grams = language.byte_grams(text)
    raw = b" " + b" ".join(text.encode().translate(language.SPACE).split()) + b" "
    assert grams.tolist() == [int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)]
    places = list(zip(*(p.tolist() for p in f.places(grams)), strict=True))
    for lang, share in zip(f.languages, f.shares(text), strict=True):
        hits = sum(all(p in plain[lang] for p in ps) for ps in places)
        chance = (len(plain[lang]) / f.masks.shape[1]) ** language.PROBES
        assert share == pytest.approx(max(0.0, (hits / len(grams) - chance) / (1 - chance)))
    assert f.predict(" ".join(words[330:355]))[0] == "l33"


def test_rare_languages_are_learned(spark):
    rows = [(i, "the quick brown fox jumps over lazy dogs", "en") for i in range(3000)] + [(9000 + i, "η γρήγορη καφέ αλεπού", "el") for i in range(2)]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=50)
    assert filters.languages == ["el", "en"] and filters.predict("καφέ αλεπού")[0] == "el" and filters.predict("lazy fox")[0] == "en"
    sample = language.sample_by_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample}["el"] == 2 and 20 <= {r["lang"]: r["count"] for r in sample}["en"] <= 90


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, data).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for t, p in held if t == 1) >= 0.75 * sum(t for t, _ in held)
    assert sum(p for t, p in held if t == 0) <= 0.02 * len(held)


@pytest.fixture(scope="module")
def evidence(spark):
    plain = "the quiet river runs along green meadows while people walk home"
    rows = [(i, f"{plain} number{i} {'you idiot' if i % 4 == 0 else 'my friend'} stays", int(i % 4 == 0)) for i in range(400)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


@pytest.mark.parametrize("text", ["you idiot", "You IDIOT!!", "such an 1d10t", "i d i o t indeed", "i.d.i.o.t", "iiidiooot", "!d!ot", "id-iot"])
def test_disguised_words(evidence, text):
    assert evidence.score(text) >= 0.3


@pytest.mark.parametrize("text", ["", "my friend", "call +1 (906) 555-7738", "a b c d e f", "44.144.126.223", "e3b3ed3cc8548923d", "home 2024-01-15"])
def test_clean_words(evidence, text):
    assert evidence.score(text) < 0.3


@pytest.mark.parametrize("token", ["1d10t", "i-d1ot", "iidioot", "$tup1d", "st.u.p", "4a4", "b@dd", "x", "!!", "aa", "i|i"])
def test_viterbi_against_all_paths(evidence, token):
    """The decoded word is one of the least costly among all that the lattice allows."""
    import itertools

    def cost(word, extra):
        padded = "^^" + word + "$"
        return extra + sum(evidence.model.cost(padded[i : i + 2], padded[i + 2]) for i in range(len(word) + 1))

    every = [("".join(t for t, _ in path), sum(c for _, c in path)) for path in itertools.product(*toxicity.lattice(token))]
    least = min(cost(word, extra) for word, extra in every)
    got = toxicity.decode(evidence.model, token)
    assert min(cost(word, extra) for word, extra in every if word == got) == pytest.approx(least)


def test_toxicity_odd_rows(spark, evidence):
    assert toxicity.score(odd(spark), evidence).count() == len(ODD)
    kept = toxicity.clean_only(odd(spark), evidence)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    nothing = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score(odd(spark), nothing).collect())


def plain_alignment(item, text):
    best = 0
    rows = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best / (2 * len(item))


def test_contamination_against_brute_force(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(docs, bench).collect()}
    items = {r["item_id"]: decontam.words(r["text"]) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        ws = decontam.words(r["text"] or "")
        held = Counter(ws)
        for k, item in items.items():
            if sum((Counter(item) & held).values()) >= decontam.LEAST_SCORE * len(item):  # fewer words in common can't score enough
                score = plain_alignment(item, ws)
                if score >= decontam.LEAST_SCORE:
                    want[r["doc_id"], k] = score
    assert got == pytest.approx(want)


def test_edited_copies(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    edited = item.replace("seven ", "7 ").replace("fourteen ", "") + " and more"
    docs = spark.createDataFrame([(1, "before it " + item.upper() + " after"), (2, edited), (3, "one two three four but nothing else of it at all"), (4, None), (5, ""), (None, item)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (None, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench, block_size=1).collect()} == got
    kept = decontam.clean_of(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None}
    assert decontam.contamination(docs, bench.limit(0)).count() == 0 and decontam.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("every", [4, 5, 6])
@pytest.mark.parametrize("exact_copy", [False, True])
def test_recall_of_copies_edited_throughout(spark, every, exact_copy):
    item = [f"word{i}" for i in range(60)]
    edited = [f"other{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    doubled = [x for i, w in enumerate(item) for x in ([w, f"more{i}"] if i % 2 else [w])]
    rows = [(1, " ".join(["before", *edited, "after"])), (2, " ".join(doubled)), (3, " ".join(item[::2]))] + [(4, " ".join(item))] * exact_copy
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {d: plain_alignment(item, text.split()) for d, text in rows}
    assert got == pytest.approx({d: x for d, x in want.items() if x >= decontam.LEAST_SCORE}) and set(got) >= {1, 2}


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2, 0.25])
def test_recall_against_full_alignment(rate):
    """Copies with words replaced, left out or added at random, in running text: what full alignment finds without any seeds is found."""
    import numpy as np

    rng = np.random.RandomState(int(rate * 100))
    common = [f"c{i}" for i in range(300)]
    pick = lambda n: [common[i] for i in (rng.zipf(1.3, n) - 1) % 300]
    rows = [{"pid": k, "words": pick(n)} for k, n in enumerate([12, 25, 60] * 12)]
    block, found, reached = decontam.Block(rows, decontam.LEAST_SCORE), 0, 0
    for r in rows:
        copy = [x for w in r["words"] for x in ([w] if rng.rand() >= rate else [["other"], [], [w, "more"]][rng.randint(3)])]
        text = pick(40) + copy + pick(40)
        score = plain_alignment(r["words"], text)
        got = {p: s for p, s, _, _ in decontam.matches_of(block, " ".join(text), decontam.LEAST_SCORE)}
        assert got.get(r["pid"]) == (pytest.approx(score) if score >= decontam.LEAST_SCORE else None)
        found, reached = found + (r["pid"] in got), reached + 1
    assert found >= (0.9 if rate <= 0.2 else 0.75) * reached  # beyond that many copies score less than is asked, by full alignment too


def test_copies_across_windows_and_repeated_rows(spark):
    assert decontam.windows(128, 128) == [0] and decontam.windows(132, 128) == [0, 4] and decontam.windows(256, 128) == [0, 64, 128] and decontam.windows(5, 128) == [0]
    long = [f"word{i}" for i in range(256)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:128])), (1, " ".join(long)), (3, " ".join(long[:128]))], "item_id long, text string")
    rows = [(1, "so " + " ".join(long[64:192])), (2, " ".join(long[30:158])), (2, " ".join(long[30:158])), (3, " ".join(long[100:130])), (None, " ".join(long)), (None, " ".join(long[:128]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 1): 1.0, (2, 1): pytest.approx(98 / 128, abs=0.03), (2, 2): pytest.approx(98 / 128), (2, 3): pytest.approx(98 / 128), (None, 1): 1.0, (None, 2): 1.0, (None, 3): 1.0}
    for size in (1, 2, 20_000):
        got = decontam.contamination(docs, bench, block_size=size).collect()
        assert len(got) == 7 and {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_long_short_and_unspaced_items(spark):
    long = [f"word{i}" for i in range(134)]
    thai, chinese = "แมวสีดำนอนอยู่บนหลังคา", "黑色的猫睡在屋顶上面"
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "Rare Pair"), (3, chinese), (4, thai)], "item_id long, text string")
    rows = [(1, "a clean text that says " + " ".join(long[128:]) + " by chance"), (2, "all of it " + " ".join(long)), (3, "such a rare, pair indeed"), (4, "rare is the pair")]
    rows += [(5, f"他说{chinese}。然后走了"), (6, f"เขาบอกว่า{thai}แล้วไป"), (7, "别的句子完全不同")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(2, 1), (3, 2), (5, 3), (6, 4)}


@pytest.fixture(scope="module")
def spaced(spark):
    plain = "i saw a quiet river and what a river it was when people walk home and i sat in the sun up on a hill"
    rows = [(i, f"{plain} number{i} {('you idiot', 'so stupid')[i // 4 % 2] if i % 4 == 0 else 'my friend'} stays", int(i % 4 == 0)) for i in range(400)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


@pytest.mark.parametrize("text", ["what a i d i o t", "y o u i d i o t", "I i d i o t", "i d i o t a n d s t u p i d", "id iot", "so st upid", "s t upid", "an i d iot", "1 d 1 0 t", "what a 1d iot"])
def test_spaced_words(spaced, text):
    assert spaced.score(text) >= 0.3


def test_two_spelled_words(spaced):
    assert {"idiot", "stupid"} <= spaced.found(["s t u p i d i d i o t"])[0]


@pytest.mark.parametrize("text", ["i saw a river up in the sun", "a b c d e f", "i d", "1 2 3 4 5 6", "what a walk it was", ". . . - - -"])
def test_spaces_of_clean_words(spaced, text):
    assert spaced.score(text) < 0.3


def test_character_model_of_all_documents(spark):
    labelled = [(i, "you idiot" if i % 2 else "my friend", i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, text) for i, text, _ in labelled] + [(100 + i, "zzyzx") for i in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, toxic) for i, _, toxic in labelled], "doc_id long, toxic int")
    three = toxicity.learned(docs, marks).model.three
    assert three["zyz"] == 50 and three["idi"] == 20
    assert toxicity.fit(docs.join(marks, "doc_id"), most=5).model.three["idi"] == 20
