"""Every operator against a plain version of its contract, and on tables with all that may go wrong."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import boosting, embeddings, licences, mixing, nearduplicates, packing, pii, quality, secrets, substrings, tagger, urls, words
from evidra.llm.components import components
from tests.conftest import DATA
from tests.llm.helpers import documents, odd_documents, rows_by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text for r in small.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")


@pytest.fixture(scope="module")
def model():
    return pii.Finder(tagger.fit(*pii.made_windows(300), pii.TAGS, epochs=3), [0.5] * 4, [0.0] * 4)


@pytest.fixture(scope="module")
def net():
    from evidra.llm import convnet

    return convnet.fit(*secrets.made_candidates(1500), tagger.N_CHARS, secrets.RECALL)


def _apply(name, docs, labels, model, net):
    return {
        "licences": lambda: licences.scan(docs),
        "pii": lambda: pii.scan(docs, model),
        "redact": lambda: pii.redact(docs, model),
        "near": lambda: nearduplicates.groups(docs),
        "pack": lambda: packing.pack(docs),
        "pack ids": lambda: packing.pack(docs, with_ids=True),
        "plan": lambda: mixing.plan(docs),
        "mix": lambda: mixing.mix(docs),
        "substrings": lambda: substrings.dedup(docs, with_text=True),
        "quality": lambda: quality.score(docs, quality.fit(docs, labels)),
        "secrets": lambda: secrets.scan(docs, net),
    }[name]()


ALL = ["licences", "pii", "redact", "near", "pack", "pack ids", "plan", "mix", "substrings", "quality", "secrets"]


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, labels, model, net, name):
    assert _apply(name, documents(spark, []), labels.limit(0), model, net).collect() == []


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(spark, labels, model, net, name):
    docs = odd_documents(spark)
    out = _apply(name, docs, labels.limit(0), model, net)
    rows = out.collect()
    if name == "redact":
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))  # nothing to redact, all columns stay
    elif name == "mix":
        assert set(out.columns) == set(docs.columns) and not {1, 2, 3} & {r.doc_id for r in rows}
    elif name in ("pack", "pack ids"):
        n = Counter(r.doc_id for r in rows if r.piece == 0)
        assert n[4] == 2 and n[1] == n[2] == n[None] == 1
        assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
        by_sequence = defaultdict(list)
        for r in rows:
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for places in by_sequence.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
    else:
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    if name == "near":
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
        assert by[1] == {(0, 1, True)} and by[3] == {(0, 3, True)} and by[10] == {(1, 10, True)}
        assert {c for i in (4, 5, 6) for _, c, _ in by[i]} == {4} and {k for *_, k in by[5]} == {False}
        assert next(iter(by[None]))[1:] == (None, False)
    if name == "substrings":
        by = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
        assert {(1, 0, 0), (4, 120, 0), (5, 120, 120), (6, 121, 120), (None, 5, 0), (8, 1, 0)} <= by
    if name == "quality":
        assert all(not r.kept and r.base_failed for r in rows if r.doc_id in (1, 2, 3, 10))


# --- licences


def test_licence_scan_matches_contract(small, texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, r in rows_by_id(licences.scan(small)).items():
        ws = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        found = [(k, label) for phrase, label in licences.PHRASES.items() for n in [len(phrase.split())] for k in range(len(ws)) if ws[k : k + n] == phrase.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(found), ",".join(sorted({x for _, x in found})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_automaton_finds_longest_matches():
    rng = random.Random(1)
    sequences = [[rng.randint(1, 4) for _ in range(rng.randint(3, 25))] for _ in range(6)]
    a = licences.Automaton(sequences)
    inside = lambda part: any(part == s[i : i + len(part)] for s in sequences for i in range(len(s)))
    for _ in range(40):
        text = [rng.randint(1, 5) for _ in range(40)]
        got = {end: (n, state) for end, n, state in a.matches(text, 1)}
        for end in range(1, len(text) + 1):
            n = max((k for k in range(end + 1) if inside(text[end - k : end])), default=0)
            ends_here = n and (end == len(text) or not inside(text[end - n : end + 1]))
            assert (end in got) == bool(ends_here)
            if ends_here:
                assert got[end][0] == n
                for k, at in a.ends[got[end][1]].items():
                    assert sequences[k][at - n : at] == text[end - n : end]
                assert set(a.ends[got[end][1]]) == {k for k, s in enumerate(sequences) if any(text[end - n : end] == s[i : i + n] for i in range(len(s)))}


def test_licence_template_with_edits():
    ws = licences.TEMPLATES["mit"][0].split()
    ws[20:21] = ["changed", "words"]
    found = licences.spans([w.encode() for w in ["before"] * 9 + ws + ["after"] * 9])
    assert max(s for *_, s in found) > 0.9 and any((a, b) == (9, 9 + len(ws)) for _, a, b, _ in found)


# --- personal data


def test_pii_matches_contract(small, texts, model):
    for i, r in rows_by_id(pii.scan(small, model)).items():
        plain = []
        for kind in pii.KINDS:
            for m in pii.PATTERNS[kind].finditer(texts[i]):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
                if ok:
                    plain.append(f"{kind}:{m.start()}:{m.end()}")
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(p.startswith(k) for p in plain) for k in pii.KINDS]
        assert set(plain) <= set(r.spans.split(",")) | ({""} if not plain else set())


def test_emails_as_the_pattern_finds_them():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-_ %é") for _ in range(25))
        assert pii._emails(t) == [(m.start(), m.end()) for m in pii.PATTERNS["email"].finditer(t)]


def test_long_runs_of_digits_and_spaces():
    assert pii.base_spans("1" * 200_000 + ".1.1.1" + " " * 100_000 + "1.2.3.4.5") == [(1, 300_006, 300_013)]
    assert pii.base_spans("+" * 1000 + "1 " * 3 + "(" * 50_000) == []


def test_luhn_known_numbers():
    assert pii.luhn("4532015112830366") and not pii.luhn("4532015112830367")


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    m = tagger.fit(*(x[:8, :12] for x in pii.made_windows(8)), pii.TAGS, hidden=4, dim=3, epochs=0)
    for k in m.p:
        m.p[k] = m.p[k].astype(float)
    ids, tags = (x[:8, :12] for x in pii.made_windows(8))
    _, grads = m._step(ids, tags)
    for k, v in m.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up = m._step(ids, tags)[0]
            v[at] = old - eps
            down = m._step(ids, tags)[0]
            v[at] = old
            assert abs((up - down) / (2 * eps) - grads[k][at]) < 1e-4 + 1e-3 * abs(grads[k][at]), k


def test_redact(spark):
    docs = documents(spark, ["mail a.b@c.de or +1 (988) 555-2485.", None])
    rows = rows_by_id(pii.redact(docs, None))
    assert rows[0].text == "mail <EMAIL> or <PHONE>." and rows[0].n_chars == len(rows[0].text) and rows[1].text is None


# --- near duplicates


def _plain_groups(texts, shingle=4, percent=80):
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[k : k + shingle]) for k in range(max(1, len(ws) - shingle + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("shingle", "percent"), [(4, 80), (5, 80), (3, 50)])
def test_near_duplicates_match_brute_force(small, texts, shingle, percent):
    got = {i: (r.n_shingles, r.component_id) for i, r in rows_by_id(nearduplicates.groups(small, shingle, percent)).items()}
    want = _plain_groups(texts, shingle, percent)
    if percent == 80:
        assert got == want
    else:  # bands are made for 0.8
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}


def test_chain_of_near_copies_is_one_group(spark):
    """Each text differs from the next by a word more; the first and the last have little in common."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(100)]
    texts = []
    for k in range(12):
        texts.append(" ".join(base))
        base[8 * k + 2] = f"new{k}"
    texts += [" ".join(rng.choice(base) for _ in range(60)) for _ in range(5)] + ["a b", "A  b", "a b c"]
    docs = documents(spark, texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows_by_id(nearduplicates.groups(docs)).items()} == _plain_groups(dict(enumerate(texts)))


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    """Copies near the limit, in blocks of a few classes."""
    monkeypatch.setattr(nearduplicates, "BLOCK", 8)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(90)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(t[: rng.randint(80, 90)]))
    docs = documents(spark, texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows_by_id(nearduplicates.groups(docs)).items()} == _plain_groups(dict(enumerate(texts)))


def test_small_pairs_at_the_limit(spark):
    """Pairs of 5 and 4, 6 and 5 shingles, whose registers are mostly borrowed."""
    texts = []
    for k in range(4000):
        ws = [f"w{k}x{i}" for i in range(8 + k % 2)]
        texts += [" ".join(ws), " ".join(ws[:-1])]
    got = rows_by_id(nearduplicates.groups(documents(spark, texts)))
    assert [i for i, r in got.items() if r.component_id != i - i % 2] == []


def test_register_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for n in (5, 40, 300, 3000):
        for _ in range(20):
            common, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (8 * n, n, n))
            x, y = (np.unique(words.mixed(np.concatenate([common, z]))) for z in (a, b))
            x, y = nearduplicates.registers(x), nearduplicates.registers(y)
            errors.append(float(nearduplicates.estimates(x, y)) - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.15


# --- packing


def test_packing_round_trip(small, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(small, with_ids=True).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, text in texts.items():
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == t.encode(text, add_special_tokens=False).ids + [2]
        assert all(r.length == 1024 for r in got[1:]) and [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for g in pieces.values() for r in g)
    assert len(sequences) <= 1.05 * -(-total // 1024) + 1


def test_encoder_equals_reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k")
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "ß", "中", "\xa0", ".", "<|endoftext|>", " the", "\u200b", "😀"]) for _ in range(rng.randint(0, 12)))
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_plan_uses_up_all_lengths():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 3000):
        counts = Counter(rng.integers(1, 1025, n).tolist())
        plan = packing.planned(counts)
        used = Counter()
        for p, k in plan:
            assert sum(p) <= 1024 and k > 0
            for v in p:
                used[v] += k
        assert used == counts
    total = sum(v * k for v, k in counts.items())
    assert sum(k for _, k in plan) <= 1.02 * max(total / 1024, sum(k for v, k in counts.items() if v > 512)) + 1


def test_fitted_repeats_solve_least_squares():
    counts = np.zeros(11, np.int64)
    counts[[4, 6, 5]] = 7, 7, 4
    rows = (np.array([0, 0, 1, 2]), np.array([6, 4, 5, 5]), np.array([1, 1, 2, 1]))
    x, off = packing.fitted(counts, rows, np.array([0, 0, 0.5]), cost=0.1)
    assert np.allclose(x, [7, 2, 0], atol=0.05) and off < 0.2


def _patterns(counts, length, slack):
    pieces, times = packing.few_document_patterns(counts, length, slack)
    return {tuple(sorted(v for v, k in zip(p, t, strict=True) for _ in range(k) if v)) for p, t in zip(pieces.tolist(), times.tolist(), strict=True)}


def test_patterns_are_those_of_the_lengths():
    counts = np.zeros(21, np.int64)
    counts[[12, 8, 5, 3, 4]] = 3, 1, 1, 9, 0
    rows = _patterns(counts, 20, 20)
    assert {(8, 12), (3, 5, 12), (3, 3, 5, 8), (12,), (3, 3, 3, 3)} <= rows and (8, 8) not in rows and not any(4 in r for r in rows)
    assert {(8, 12), (3, 5, 12)} <= _patterns(counts, 20, 0) and all(sum(r) == 20 for r in _patterns(counts, 20, 0))


def test_short_lengths_are_taken_in_runs():
    counts = np.zeros(81, np.int64)
    counts[[60, 4, 7]] = 3, 90, 90
    rows = _patterns(counts, 80, 0)
    assert (4, 4, 4, 4, 4, 60) in rows and (4,) * 20 in rows
    counts[4] = 3
    assert (4, 4, 4, 4, 4, 60) not in _patterns(counts, 80, 0)


def test_open_space_takes_what_is_left():
    left = np.zeros(21, np.int64)
    left[[2, 3]] = 3, 2
    plan = packing.filled([((17,), 2), ((12, 6), 2)], left, 20)
    assert Counter(dict(plan)) == Counter({(17, 3): 2, (12, 6, 2): 2}) and left.sum() == 1


def _shapes():
    rng = np.random.default_rng(0)
    yield {v: 1000 for v in range(1, 41)}
    yield Counter(rng.integers(1, 201, 50_000).tolist())
    yield Counter(rng.integers(50, 151, 50_000).tolist())
    yield Counter(np.clip(np.exp(rng.normal(np.log(120), 1, 100_000)).astype(int), 1, 1024).tolist())
    yield Counter(np.clip(rng.exponential(250, 200_000).astype(int), 1, 1024).tolist())
    yield Counter(rng.integers(1, 1025, 50_000).tolist())
    yield Counter(rng.integers(500, 1025, 30_000).tolist())
    yield Counter(rng.integers(1, 13, 3000).tolist())
    yield {600: 1000, 30: 8000, 1024: 5}


@pytest.mark.parametrize("counts", list(_shapes()), ids=["1-40", "1-200", "50-150", "lognormal", "exponential", "1-1024", "500-1024", "1-12", "two"])
def test_plans_of_many_shapes(counts):
    """At most a sequence in 200 more than plain best fit, whatever the lengths."""
    left = [0] * 1025
    for v, n in counts.items():
        left[v] = n
    plain, plan = sum(n for _, n in packing.best_fit(left, 1024)), packing.planned(counts)
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 1024 and n > 0
        for v in p:
            used[v] += n
    assert used == Counter(counts) and sum(n for _, n in plan) <= 1.005 * plain + 0.5


def _histogram(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/{folder}/documents.parquet")
    return {r["length"]: r["n"] for r in packing.pieces(docs).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_plans_of_given_tables(spark):
    """On given tables and their multiples, at most a sequence in 500 more than plain best fit."""
    for folder, times in (("sf0.001", 1), ("sf0.001", 10), ("sf0.01", 10)):
        counts = {v: n * times for v, n in _histogram(spark, folder).items()}
        left = [0] * 1025
        for v, n in counts.items():
            left[v] = n
        plain = sum(n for _, n in packing.best_fit(left, 1024))
        plan = packing.planned(counts)
        used = Counter()
        for p, n in plan:
            for v in p:
                used[v] += n
        assert used == counts and all(sum(p) <= 1024 for p, _ in plan)
        size = sum(n for _, n in plan)
        assert size <= 1.002 * plain + 0.5, (folder, times, size, plain)


# --- mixing


def _plain_targets(sizes, weights=(3, 1, 2)):
    keys = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: float(weights[i % 3]) for i, k in enumerate(keys)}
    left, rest, out = set(keys), 1.5 * sum(sizes.values()), {}
    while left:
        share = {k: rest * w[k] / sum(w[j] for j in left) for k in left}
        over = [k for k in left if share[k] > 2 * sizes[k]]
        if not over:
            return out | share
        for k in over:
            out[k] = 2.0 * sizes[k]
            rest -= out[k]
            left.remove(k)
    return out


@pytest.mark.parametrize("sources", [["a"], ["b", "a", None], ["b", "b", "b", "b", "b", "a", "c", None, "é", "z"]])
def test_mixing_targets(spark, sources):
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(400)]
    rows = mixing.plan(documents(spark, texts, sources)).collect()
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[sources[i % len(sources)]] += len(t.split())
    want, taken = _plain_targets(sizes), Counter()
    for r in rows:
        s = sources[r.doc_id % len(sources)]
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61 + 0.02 * want[s]
    assert sorted(rows) == sorted(mixing.plan(documents(spark, texts, sources)).collect())  # reruns agree


def test_mix_emits_what_the_plan_takes(small):
    plan = {r.doc_id: r.taken // r.size for r in mixing.plan(small).collect() if r.size}
    got = Counter(r.doc_id for r in mixing.mix(small).collect())
    assert got == Counter({i: n for i, n in plan.items() if n})


# --- urls


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 620)] + [(700, k) for k in range(701, 900)] + [(5, 5), (None, 3)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}


def test_url_rules(spark):
    cases = [
        (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
        (2, "HTTP://A.EXAMPLE.NET/en/1?q", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (4, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (5, "http://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
        (6, "http://a.net", "a.net", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "nothing", "", "", None, "allow"),
        (9, "x://://y/z", "", "", None, "allow"),
        (10, "a://net?://b/", "net", "", None, "allow"),
        (11, "http://a.net\n/x", "a.net\n", "/x", None, "allow"),
    ]
    cases.append((12, "x" * 60_000 + "/?", "", "", None, "allow"))
    cases.append((13, "h" * 30_000 + "://A.Net/" + "y" * 30_000, "a.net", "/" + "y" * 30_000, "net/", "block"))
    cases[8] = (9, "x://:b/z", ":b", "/z", None, "allow")
    rows = rows_by_id(urls.judge(spark.createDataFrame([(i, u, None) for i, u, *_ in cases], "page_id long, url string, html string")), "page_id")
    for i, _, *want in cases:
        assert list(rows[i][1:]) == want, i


def test_links_between_pages(spark):
    base = "http://a.info/x/p.html"
    cases = [
        ("<link rel='canonical' href='../en/c.html'>", "a.info/en/c.html"), ('<link rel="alternate canonical" href="/y">', "a.info/y"), ('<LINK HREF=q.html REL=Canonical>', "a.info/x/q.html"), ('<link data-rel="canonical" href="/no">', None),
        ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/yes">', "a.info/yes"), ('<!-- <link rel="canonical" href="/no">', None), ('<link rel="canonicals" href="/no">', None), ('<link rel="canonical" href="mailto:a@b.net">', None),
        ('<link rel="canonical" href="javascript:go()">', None), ('<link rel="canonical" href="#top">', None), ('<link rel="canonical" href="?k=1">', "a.info/x/p.html?k=1"), ('<link rel="canonical" href="HTTPS://B.info/./z/../w/..">', "b.info/"),
        ('<link rel="canonical" href="/../../a/./b/.">', "a.info/a/b/"), ('<meta content="3; URL=\'/r\'" http-equiv="refresh">', "a.info/r"), ('<meta name="refresh" content="0; url=/no">', None), ('<link rel="canonical" href="a//b/../c?x=..">', "a.info/x/a//c?x=.."), ("", None), (None, None)]
    df = spark.createDataFrame([(i, base, h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    for i, (html, want) in enumerate(cases):
        got = [r["n"] for r in urls.page_edges(df.where(f"page_id = {i}")).select(urls.node(F.col("b")).alias("n")).collect()]
        assert got == ([want] if want else []), html
    pages = [(1, "http://a.info/en/c.html", None), (2, "http://a.info/a/../en/./c.html", None), (3, "http://bad.net/", '<link rel="canonical" href="http://a.info/x/../en/c.html">')]
    pages += [(10 + i, f"{base}?{i}", h) for i, (h, _) in enumerate(cases)] + [(40, "http://b.info/", '<link rel=canonical href="//bad.net/"><link rel=canonical href="/other">'), (41, None, "x"), (42, "none", None), (43, "http://x.org/fr/", '<link rel="canonical" href="http://a.info/y">')]
    rows = rows_by_id(urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(db.execute(urls.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in rows.values())
    assert {rows[i].verdict for i in (10, 11, 40)} == {"block", "allow"} and rows[11].rule is None
    assert {i: rows[i].verdict for i in (1, 2, 3)} == {1: "block", 2: "block", 3: "block"} and rows[2].path == "/a/../en/./c.html"


def test_aliases_share_decisions(spark):
    link = '<html><head><LINK href="{}" rel=canonical></head>'
    refresh = '<meta http-equiv="Refresh" content="0; url={}">'
    pages = [
        (1, "http://bad.net/a", refresh.format("http://mirror.info/a")),  # blocked by rule
        (2, "https://mirror.info/a#x", ""),  # its alias
        (3, "http://mirror.info/b", link.format("//mirror.info/a")),  # alias of the alias
        (4, "http://mirror.info/c", link.format("/d")),
        (5, "http://mirror.info/d", link.format("http://ok.org/fr/z?a=1&amp;b=2")),  # an allowed place
        (6, "http://bad.net/e", link.format("http://mirror.info/d")),  # blocked by its own rule, among allowed aliases
        (7, "http://mirror.info/f", link.format("g")),
        (8, "http://mirror.info/g", None),
        (9, "http://from.info/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://from.info", "http://bad.net/a"), (None, "x")], "a string, b string")
    got = {i: r.verdict for i, r in rows_by_id(urls.judge(df, more), "page_id").items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "block"}


# --- substrings


def _plain_substrings(texts):
    first = {}
    ws = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(ws):
        for k in range(len(ws[i]) - 49):
            first.setdefault(tuple(ws[i][k : k + 50]), i)
    out = {}
    for i, w in ws.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substrings_match_brute_force(small, texts):
    assert {i: tuple(r[1:]) for i, r in rows_by_id(substrings.dedup(small)).items()} == _plain_substrings(texts)


def test_passages_of_all_lengths_and_places(spark):
    rng = random.Random(10)
    word = lambda: rng.choice("ab") * rng.randint(1, 3) + rng.choice("xyz")
    passage = [word() for _ in range(140)]
    texts = []
    for k in range(40):
        at = rng.randint(0, 80)
        cut = passage[at : at + rng.choice([12, 48, 49, 50, 51, 60])]
        texts.append(" ".join([f"u{k}_{j}" for j in range(rng.randint(0, 60))] + cut + [f"v{k}_{j}" for j in range(rng.randint(0, 30))] + cut * rng.randint(0, 1)))
    texts += ["same " * 300, "same " * 49, " ".join(passage), "  ".join(passage)]
    docs = documents(spark, texts)
    assert {i: tuple(r[1:]) for i, r in rows_by_id(substrings.dedup(docs)).items()} == _plain_substrings(dict(enumerate(texts)))


def test_repeated_ids_lose_only_what_others_have(spark):
    """Rows of one id with different texts: what stands nowhere else stays, and neither is the other's reference."""
    rng = random.Random(4)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(80)]
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + c), (3, c), (4, c[:60])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs).collect())
    assert got == sorted([(1, 80, 0), (2, 80, 80), (2, 80, 0), (2, 80, 0), (3, 160, 80), (3, 80, 0), (4, 60, 60)])


def test_factors_are_matches(small, texts, spark):
    """Each factor's words stand at its reference's place, in a document with a smaller id; factors of one reference that
    meet are one; and all that a plain parser finds is covered."""
    rng = random.Random(21)
    shared = [f"p{i}" for i in range(300)]
    made = {k: " ".join([f"u{k}_{j}" for j in range(rng.randint(0, 70))] + shared[(at := rng.randint(0, 150)) : at + rng.randint(45, 150)] + [f"v{k}_{j}" for j in range(rng.randint(0, 70))] + shared[:60] * rng.randint(0, 1)) for k in range(40)}
    for table in (texts, made):
        docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
        ws = {i: WORD.findall(t) for i, t in table.items()}
        want = _plain_substrings(table)
        n = 0
        for r in substrings.dedup(docs, with_text=True).collect():
            seen = set()
            for f in r.factors or []:
                n += 1
                assert f.end - f.start >= 50 and f.doc < r.doc_id and ws[r.doc_id][f.start : f.end] == ws[f.doc][f.place : f.place + f.end - f.start]
                seen.update(range(f.start, f.end))
            assert r.n_removed == want[r.doc_id][1] and (not r.factors or len(seen) == r.n_removed)
            for x in r.factors or []:
                assert not any(x is not y and (x.doc, x.place - x.start) == (y.doc, y.place - y.start) and x.start <= y.start <= x.end for y in r.factors)
        assert n > 0


def test_run_hashes_do_not_depend_on_place():
    ws = [b"a", b"b", b"c", b"d"]
    x = substrings._runs(substrings._two(ws * 3), np.array([0, 4, 8, 1, 0]), np.array([4, 8, 12, 4, 3]))
    y = substrings._runs(substrings._two([b"z", *ws]), np.array([1]), np.array([5]))
    assert x[0] == x[1] == x[2] == y[0] and len({x[0], x[3], x[4]}) == 3


def test_rolling_hashes():
    h = words.hashes([b"a", b"b", b"a", b"b", b"c", b"a", b"b"])
    for k in range(1, 8):
        r = words.rolling(h, k)
        assert len(r) == 8 - k
        if k == 2:
            assert r[0] == r[2] == r[5] != r[1]
    assert len(words.rolling(h, 8)) == 0


# --- quality


def test_quality_statistics_match_contract(small, texts, labels):
    rows = rows_by_id(quality.score(small, quality.fit(small, labels)))
    for i, t in texts.items():
        ws = WORD.findall(t)
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        n = Counter(grams)
        repeat = len({j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * repeat > 50 * len(ws)) and not (r.base_failed and r.kept)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.score(docs, quality.fit(docs, fit_on)).join(held, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r.quality], [r for r in got if not r.quality]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_trees_keep_constraints_and_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 4))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.3 * np.sin(4 * x[:, 2]) + rng.normal(0, 0.3, 1500) > 0).astype(float)
    t = boosting.fit(x, y, {0: 1, 1: -1})
    assert ((t.probability(x) > 0.5) == (y > 0)).mean() > 0.9
    for feature, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, feature] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(t.raw(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    assert len(boosting.fit(np.zeros((0, 4)), np.zeros(0)).leaf) == 0


# --- embeddings


def _plain_vectors(rows, least=0.93):
    ok = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok.setdefault((label, len(v)), []).append((i, np.array(v, np.float32).astype(float)))
    links, root = Counter(), {i: i for i, *_ in rows if i is not None}
    find = lambda i: i if root[i] == i else find(root[i])
    for g in ok.values():
        for a, (i, v) in enumerate(g):
            for j, w in g[a + 1 :]:
                if v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= least:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in root}


def test_embeddings_match_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert {i: (r.n_links, r.component_id) for i, r in rows_by_id(embeddings.groups(table), "vec_id").items()} == _plain_vectors(rows)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PART", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (6, 10))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.25, 10)).astype(np.float32).tolist(), int(i % 2)) for i in range(150)]
    rows += [(200 + i, base[0].astype(np.float32).tolist(), 0) for i in range(40)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 10, 0), (303, [float("nan")] * 10, 0), (304, [float("inf")] + [1.0] * 9, 0), (305, [None] + [1.0] * 9, 0), (306, base[0].tolist(), None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [1e30] * 10, 1), (310, [1e-30] * 10, 1), (311, [-0.0, 1.0], 0), (312, [0.0, 1.0], 0)]
    got = embeddings.groups(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, same string"))
    assert {i: (r.n_links, r.component_id) for i, r in rows_by_id(got, "vec_id").items()} == _plain_vectors(rows)
    assert embeddings.groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


# --- secrets


def test_secrets_match_contract(small, texts, net):
    hex_run = re.compile("[0-9a-f]+")
    for i, r in rows_by_id(secrets.scan(small, net)).items():
        t = texts[i]
        plain = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
        plain += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in hex_run.finditer(t) if len(m[0]) >= 32]
        joined = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(plain)]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(",")) | {""}
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in plain) for j in range(3)]


def test_secret_edges():
    assert secrets.base_spans("PassWord : 'abcdefgh' x") == [(0, 0, 20)]
    assert secrets.base_spans("api-key=abcdefghij apikey=abcdefg") == []
    assert secrets.base_spans("pa\u017f\u017fword=abcdefghij to\u212aen=abcdefghij") == []  # only ASCII letters count in either case
    assert secrets.base_spans("f" * 32 + " AKIA" + "B" * 12) == [(2, 0, 32), (1, 33, 49)]


@pytest.mark.parametrize("at", [0, 57, 80, 101, 160])
def test_key_inside_a_long_run(net, at):
    """A long candidate is read whole: two that differ only in their middle get verdicts of their own."""
    run = ("some/plain.words/of_a-path.v2/" * 7)[:200]
    key = "ghp_Xk29QmZ7LwT4vB8nRc1Yd6Hs3Jf5Pg0aUeKi"
    for body, found in ((run, []), (run[:at] + key + run[at + len(key) :], [(3, 4, 204)])):
        assert secrets.all_spans(net, ["see " + body + " there"])[0][1] == found
    assert {k for s, e in secrets.windows(3, 203) for k in range(s, e)} == set(range(3, 203))


def test_runs_without_digits_are_judged(net):
    """Tokens that happen to hold no digit are found, in texts without one, and long plain words aren't."""
    rng = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"then send {left}{''.join(letters[i] for i in rng.integers(0, 52, 20))} to them" for left in ("Bearer ", "key: ", "auth=") for _ in range(40)]
    assert all(secrets.candidates(t) for t in texts)
    assert np.mean([bool(a) for _, a in secrets.all_spans(net, texts)]) > 0.9
    plain = ["Donaudampfschifffahrtsgesellschaft", "internationalization", "counterrevolutionary", "state-of-the-art-methods", "src/main/resources/messages", "=" * 40, "uncharacteristically"]
    assert sum(bool(a) for _, a in secrets.all_spans(net, [f"we read {w} here" for w in plain])) <= 1


def test_network_held_out(net):
    ids, y = secrets.made_candidates(600, seed=50)
    found = net.probability(ids) >= net.threshold
    assert found[y > 0].mean() > 0.93 and found[y == 0].mean() < 0.05
