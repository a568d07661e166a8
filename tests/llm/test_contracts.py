"""What every operator on documents promises whatever else is in the table, and models against slow forms."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, common, langid, linededup, packing, pii, secretscan, simhash, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, and names that differ from outputs in case only.
CLASHING = "_text _doc _print _lost _id _fp _rank _hash hash _moved _hot _own _other _blocks _in_0 _in_1 doc key fp n print pos rows first cell side drawn attempt kind entity n_Lines SPANS Score Entities N_entities".split()
EN, DE = ["the", "ing", "and", "er", "th", "on"], ["der", "ung", "sch", "ein", "ß", "ü"]


def words(seed, n, syllables=EN):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{words(i, 40, EN if i % 2 else DE)}\nWritten under the same licence\nmail a{i}@b.example.com", "en" if i % 2 else "de") for i in range(30)]
    rows += [(100, None, None), (101, "", "en"), (None, words(1, 40), "en"), (5, rows[5][1], "en")]
    return spark.createDataFrame([(*r, *[f"mine {c}" for c in CLASHING]) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))


OPERATORS = {
    "langid": (lambda d: langid.identify(d, langid.train(d, F.lit(True))), {"score"}),
    "secretscan": (lambda d: secretscan.scan(d, secretscan.train(d)), {"spans"}),
    "toxicity": (lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.lit(0).alias("toxic")), F.lit(True))), {"score"}),
    "lines": (lambda d: linededup.dedup_lines(d), {"n_lines"}),
    "bpe": (lambda d: bpe.encode_decode(d, PATH, digest_only=True), set()),
    "surrogates": (lambda d: pii.replace(d, b"k"), {"entities", "n_entities"}),
    "surrogates, joined": (lambda d: pii.replace(d.withColumn("text", F.concat("text", F.lit(" x a1@b.example.com"))), b"k", listed=-1), {"entities", "n_entities"}),
    "one of each": (lambda d: simhash.one_of_each(d), set()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_are_carried_along(clashing, name):
    run, outputs = OPERATORS[name]
    out = run(clashing)
    kept = [c for c in CLASHING if c.lower() not in outputs]
    assert set(kept) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == clashing.count() - (name == "one of each") - (name == "one of each" and 1) or name == "one of each"
    for r in rows:
        assert all(r[c] == f"mine {c}" for c in kept)


@pytest.mark.parametrize("name", ["simhash", "packing"])
def test_operators_with_columns_of_their_own_do_not_look_at_others(clashing, name):
    out = simhash.near_duplicates(clashing) if name == "simhash" else packing.pack(clashing, PATH)
    assert out.count() >= clashing.count()


def test_fresh_names_differ_whatever_their_case():
    assert common.fresh(["A", "b_"], "a", "b", "c") == ["a_", "b", "c"]
    assert common.fresh(["x"], "x", "x") == ["x_", "x__"]


def test_a_look_up_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k in range(8) for i in range(k + 1)] + [(99, 0)], "k long, i long")
    found = rows.filter("k < 90").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    for how in ("inner", "left"):
        got = sorted((tuple(r) for r in common.look_up(rows, found, ["k"], "n", how).select("k", "i", "top").collect()), key=repr)
        assert got == sorted((tuple(r) for r in rows.join(found, "k", how).select("k", "i", "top").collect()), key=repr)


def test_a_session_on_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session())


# languages


def test_languages_against_a_loop_over_encoders(spark):
    import zstandard as z

    rows = [(i, words(i, random.Random(i).randint(3, 600), EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, F.col("doc_id") < 60)
    found = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    for i, text, _ in rows:
        data = "".join(" " if ord(c) < 128 and not c.isalpha() else c for c in text.lower()).encode()
        sizes = {}
        for lang, content in model.dictionaries.items():
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False, window_log=17, hash_log=15, chain_log=15, strategy=z.STRATEGY_BTULTRA2, min_match=3, search_log=7)
            dictionary.precompute_compress(compression_params=p)
            sizes[lang] = sum(len(z.ZstdCompressor(dict_data=dictionary, compression_params=p).compress(data[at : at + 4096])) for at in range(0, len(data), 4096))
        (best, lang), (second, _) = sorted((n, x) for x, n in sizes.items())
        assert (found[i]["lang_pred"], found[i]["rejected"]) == (lang, second - best <= 0.002 * second)
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in rows) >= 118


def test_dictionaries_come_from_all_over_a_text():
    text = b"".join(b"%05d" % i for i in range(4000))
    taken = langid.stretches(text, 1000)
    places = [text.index(taken[at : at + 20]) for at in range(0, 1000, 125)]
    assert len(taken) == 1000 and places[0] == 0 and places[-1] > 17_000 and places == sorted(places)
    assert langid.stretches(b"short", 10) == b"short" and langid.shared_evenly([b"aaaa", b"b"], 5) == b"aa\nb\n"


# secrets

#: Secrets of makes that training does not plant, in sentences that it does not write.
HELD_OUT = (
    ("curl -H 'Authorization: Bearer {}' https://x.org", "abcDEF123456ghiJKL789mno"),
    ("the deploy key is {} for now", "Zx81kQp93LmVt72Rw5qq9"),
    ("client_secret {}", "9f8A7c6D5e4B3a2F1g0H9i8J"),
    ("we still use {} there", "ASIAJ7KQ2M5N8P4R6S1T"),
    ("please use {} here", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"),
    ("slack posts with xoxb {} daily", "1234567890ab-CDEFghij5678KLMNopqrst"),
    ("db_password -> {}", "Tr0ub4dor9Zebra"),
    ("send {} along", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3.SflKxwRJSMeKKF2QT4fwpM"),
    ("his passphrase: {}", "mango42kiwi77plum"),
    ("key {} expires", "dGhpcyBpcyBhIHNlY3JldA09xQ=="),
)
CLEAN = ("see https://www.example.com/a/b-c?page=12 for more", "call +49 170 1234567 at 12:30", "on 2024-03-01 version 1.12.7 came out", "invoice INV-2024-00123 over 1,250.00", "the password is hard to guess", "a token of thanks, a key question", "ISBN 978-3-16-148410-0", "mail jane.doe99@example.org", "COVID-19 and H2O and B2B", "the secret garden opened", "IBAN DE89 3704 0044 0532 0130 00", "internationalization of heterogeneity", "my_function_name and CamelCaseName", "/usr/lib/python3.13/site-packages", "10.0.0.255 and 192.168.0.1", "1d10t and l33t words")


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(11)
    made = [(i, f"{words(i, rng.randint(20, 200), EN if i % 2 else DE)} " + (f'token = "{rng.getrandbits(160):040x}" ' if i % 10 == 0 else "") + words(i + 5000, 30)) for i in range(600)]
    return secretscan.train(spark.createDataFrame(made, "doc_id long, text string"))


def test_the_field_finds_secrets_that_the_patterns_miss(field):
    scanner, caught, wrong = secretscan.Scanner(field), 0, 0
    for i, (sentence, value) in enumerate(HELD_OUT):
        text = f"{words(i, 30)}. {sentence.format(value)}. {words(i + 99, 30)}"
        base, every = scanner.scan(text)
        assert not any(text[s:e] == value for s, _, e in base)
        added = [(s, e) for s, k, e in every if k == "crf"]
        at = text.index(value)
        caught += any(s < at + len(value) and at < e for s, e in added)
        wrong += sum(not (s < at + len(value) and at < e) for s, e in added)
    for i, sentence in enumerate(CLEAN):
        wrong += len(scanner.added(f"{words(i, 30)}. {sentence}. {words(i + 99, 30)}"))
    assert caught >= 8 and wrong <= 1, (caught, wrong)


def test_skipping_what_is_settled_changes_nothing(field):
    scanner, rng = secretscan.Scanner(field), random.Random(12)
    for i in range(150):
        text = words(i, rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            phrase, _, _ = secretscan.planted(rng, ["one", "two", "three"], rng.random() < 0.6)
            text += f" {phrase} {words(i, rng.randint(0, 8))}"
        tokens = secretscan.TOKEN.findall(text)
        if not tokens:
            continue
        tags = secretscan.viterbi(scanner.emissions(tokens), field.moves)
        places, expected, start = [m.span() for m in secretscan.TOKEN.finditer(text)], [], None
        for k, tag in enumerate([*tags, secretscan.OUTSIDE]):
            if start is not None and tag != secretscan.INSIDE:
                expected.append((places[start][0], places[k - 1][1]))
                start = None
            if tag == secretscan.BEGIN or tag == secretscan.INSIDE and start is None:
                start = k
        assert scanner.added(text) == expected
        whole = secretscan.file_features(tokens)
        by_name = np.array([field.total(secretscan.features_at(tokens, k, whole)) for k in range(len(tokens))])
        assert np.allclose(by_name, scanner.emissions(tokens))


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(13)
    names = {f"f{i}": i for i in range(5)}
    given = [([[f"f{k}" for k in rng.choice(5, 2, replace=False)] for _ in range(n)], rng.integers(0, 3, n).tolist()) for n in (1, 3, 4)]
    data = secretscan._Windows(given, names)
    weights, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))

    def slow():
        total = 0.0
        for rows, tags in given:
            def value(path):
                steps = [2, *path, 2]
                return sum(moves[a, b] for a, b in itertools.pairwise(steps)) + sum(weights[names[f], t] for row, t in zip(rows, path, strict=True) for f in row)

            total += value(tags) - math.log(sum(math.exp(value(p)) for p in itertools.product(range(3), repeat=len(tags))))
        return total

    value, grad, grad_m = data.gradient(weights, moves)
    assert abs(value - slow()) < 1e-9
    for array, given_grad in ((weights, grad), (moves, grad_m)):
        for at in np.ndindex(array.shape):
            held = array[at]
            array[at] = held + 1e-5
            up = slow()
            array[at] = held - 1e-5
            down = slow()
            array[at] = held
            assert abs((up - down) / 2e-5 - given_grad[at]) < 1e-5


# toxicity


def test_boosting_against_every_split():
    """The first tree's splits and leaves, found by trying every feature and every edge in every node."""
    rng = np.random.default_rng(14)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3) | (rng.random(200) < 0.1)).astype(float)
    model = toxicity.boost(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))

    def grow(rows, level):
        if level == toxicity.DEPTH:
            return {tuple(rows): toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1)}
        best, cut = 1e-9, None
        for f in range(4):
            for edge in sorted({*np.unique(np.quantile(x[:, f], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])), 0.0}):
                left, right = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                if h[left].sum() <= toxicity.LEAST_LEAF / 100 or h[right].sum() <= toxicity.LEAST_LEAF / 100:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > best + 1e-12:
                    best, cut = gain, (left, right)
        if cut is None:
            return {tuple(rows): toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1)}
        return grow(cut[0], level + 1) | grow(cut[1], level + 1)

    leaves = grow(np.arange(200), 0)
    first = toxicity.Boosted(model.start, model.feature[:1], model.threshold[:1], model.leaf[:1]).margin(x) - model.start
    for rows, value in leaves.items():
        assert np.allclose(first[list(rows)], value)


def test_isotonic_against_all_monotone_blocks():
    rng = random.Random(15)
    for _ in range(60):
        n = rng.randint(1, 7)
        score, y = np.array([float(rng.randint(0, 5)) for _ in range(n)]), np.array([float(rng.randint(0, 1)) for _ in range(n)])
        levels = sorted(set(score))
        best = None
        for cuts in itertools.product((0, 1), repeat=len(levels) - 1):
            blocks, own = [], [levels[0]]
            for c, x in zip(cuts, levels[1:], strict=True):
                if c:
                    blocks.append(own)
                    own = []
                own = [*own, x]
            blocks.append(own)
            means = [y[np.isin(score, b)].mean() for b in blocks]
            if all(a <= b for a, b in itertools.pairwise(means)):
                error = sum(((y[np.isin(score, b)] - m) ** 2).sum() for b, m in zip(blocks, means, strict=True))
                best = error if best is None else min(best, error)
        found = np.interp(score, *toxicity.isotonic(score, y))
        assert abs(((found - y) ** 2).sum() - best) < 1e-9


# personal data

NAMED = {
    "Mr 王伟 came, and 王伟 left": ("王伟", "han"),
    "Mrs أحمد علي came": ("أحمد علي", "arabic"),
    "Mr राम कुमार came": ("राम कुमार", "devanagari"),
    "Mr 김철수 came": ("김철수", "hangul"),
    "Госпожа Анна Иванова пришла": ("Анна Иванова", "cyrillic"),
    "Κυρία Ελένη Παπαδοπούλου ήρθε": ("Ελένη Παπαδοπούλου", "greek"),
    "מר משה כהן הלך": ("משה כהן", "hebrew"),
    "Dr. Anne-Marie O'Brien came": ("Anne-Marie O'Brien", "latin"),
}


@pytest.mark.parametrize("text", NAMED)
def test_names_of_every_script_give_way_to_names_of_that_script(text):
    name, script = NAMED[text]
    out, found = pii.rewrite(text, b"k", {})
    assert found[0].text == name and not any(w in out for w in name.split(" "))
    start = text.index(name)
    drawn = out[start : len(out) - len(text[text.rindex(name) + len(name) :])] if text.count(name) == 1 else out[start:].split(" ")[0]
    assert {pii.script_of(w) for w in re.split(r"[ -]", drawn)} == {script}
    assert len(drawn.split(" ")) == len(name.split(" "))


def test_digits_of_every_script_give_way_to_such_digits():
    text = "call +٩٦٦ ٥٠ ١٢٣ ٤٥٦٧ or +966 50 123 4567"
    out, found = pii.rewrite(text, b"k", {})
    first, second = out[5:].split(" or ")
    assert [e.kind for e in found] == ["phone", "phone"] and found[0].canonical == found[1].canonical
    assert pii.plain_digits(first) == second != "+966 50 123 4567" and not first.isascii()


def test_given_names_keep_their_gender():
    for text, script, gender in (("My name is Maria Lopez.", "latin", "f"), ("Mr Maria Lopez", "latin", "m"), ("Меня зовут Ольга Петрова", "cyrillic", "f"), ("г-н Иван Петров", "cyrillic", "m"), ("Με λένε Γιώργος Νικολάου", "greek", "m"), ("Mrs فاطمة علي", "arabic", "f")):
        out, found = pii.rewrite(text, b"key", {})
        assert found[0].kind == "name"
        given = out[found[0].start :].split(" ")[0]
        assert given in pii.GIVEN[script][gender], (text, out)


def test_a_family_name_alone_is_that_of_the_full_name(spark):
    given = [(1, "Mr Smith met Mr John Smith. Smith left."), (2, "Mrs Smith wrote"), (3, "JOHN SMITH"), (4, "Dr. John Smith and Mr van Dyke")]
    text = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(given, "doc_id long, text string"), b"k").collect()}
    family = text[2].split()[1]
    first = re.fullmatch(rf"Mr {family} met Mr (\w+) {family}\. {family} left\.", text[1])
    assert first and first[1] in pii.GIVEN["latin"]["m"] and family != "Smith"
    assert text[3] == "JOHN SMITH" and re.fullmatch(rf"Dr\. {first[1]} {family} and Mr van \w+", text[4]) and "Dyke" not in text[4]


def test_surrogates_against_an_independent_count(spark):
    """Every entity of a corpus with few forms: one surrogate each, none shared, none that occurs."""
    rng = random.Random(16)
    families, givens = ["Ames", "Boyd", "Cole", "Dunn"], ["Ann", "Bob", "Cid", "Dee", "Eve", "Fay", "Gus", "Hal"]
    given = [(i, f"Dr. {rng.choice(givens)} {rng.choice(families)} from 10.0.0.{rng.randrange(256)}, ssn {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}, {rng.choice('abc')}@{rng.choice('xyz')}.example.com") for i in range(400)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    for listed in (pii.LISTED, -1):
        out = {r["doc_id"]: r["text"] for r in pii.replace(frame, b"k", listed=listed).collect()}
        form = re.compile(r"Dr\. (\S+ \S+) from (\S+), ssn (\S+), (\S+)")
        for part in range(4):
            pairs = {(form.fullmatch(t)[part + 1], form.fullmatch(out[i])[part + 1]) for i, t in given}
            old, new = [a for a, _ in pairs], [b for _, b in pairs]
            assert len(set(old)) == len(pairs) == len(set(new)) and not set(old) & set(new)


def test_used_up_forms_give_way_to_a_digest(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ROUNDS", 1)
    given = [(i, f"see {chr(97 + i % 26)}@b.example.com") for i in range(26)]
    out = [r["text"][4:] for r in pii.replace(spark.createDataFrame(given, "doc_id long, text string"), b"k").collect()]
    assert len(set(out)) == 26 and any(re.fullmatch("email-[0-9a-f]{32}", t) for t in out)


# packing


def least_bins(lengths, capacity):
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                put(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


def test_the_bound_and_the_proof_against_brute_force():
    rng = random.Random(17)
    proven = 0
    for _ in range(120):
        capacity = rng.choice([10, 20, 37])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        found, floor, whole = packing.search(counts, capacity)
        bins, best = sum(t for _, t in found), least_bins(lengths, capacity)
        assert floor <= best <= bins and floor == packing.least_sequences(counts, capacity)
        assert not whole or bins == best
        proven += whole
    assert proven >= 110
    assert packing.search({}, 10)[1:] == (0, True)


def test_packing_says_what_is_proven(spark):
    frame = spark.createDataFrame([(None, "a b c")] * 50 + [(1, words(1, 3000))] * 3, "doc_id long, text string")
    rows = packing.pack(frame, PATH).collect()
    assert {r["proven"] for r in rows} == {True} and {r["lower_bound"] for r in rows} == {len({r["sequence_id"] for r in rows})}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
