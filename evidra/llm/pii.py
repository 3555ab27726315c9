"""Personal data: fixed patterns with checks, and a character-level BiLSTM with CRF transitions that adds what they miss.

Offsets are code points, end exclusive. Null and empty texts have no spans. Rows are judged one by one: repeated rows
have equal results, an empty table gives an empty result, extra columns don't matter. Every kind of span holds a
digit, an @, the word "at" or spoken digits, so the network reads the neighbourhoods of these and nothing else; it reads all
of them, however long the text. What it decodes counts if the span's probability over all tag sequences (forward and
backward sums) reaches a threshold that held-out windows give for its kind."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import tagger
from evidra.llm.common import id_text, map_batches, sample_ids, session, spread

#: The kinds, in the order of all results, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Documents whose windows the network is fitted on, windows, and made-up windows, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 3000, 1500, 4500
#: Characters of a window, from one window to the next, and read on either side of an anchor.
WINDOW, STRIDE, REACH = 64, 32, 44
#: Characters of the texts that are read together.
GROUP_CHARS = 1_000_000
#: Share of held-out windows' findings of a kind that must be right, down to the least probability that counts.
PRECISION = 0.96
TAGS = 1 + 2 * len(KINDS)
#: Spoken digits.
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
_DIGIT_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: What the network reads the neighbourhoods of: a digit, an @, the word "at", two spoken digits in a row.
_ANCHOR = re.compile(rf"[0-9@\uFF20]|(?<![A-Za-z])(?:at|{_DIGIT_WORD}[ -]+{_DIGIT_WORD})(?![A-Za-z])", re.IGNORECASE)
_IP = re.compile(f"(?<![0-9]){PATTERNS['ip'].pattern}")  # the same matches: each starts where a run of digits does
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= sum(c in "0123456789" for c in found) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the patterns' spans, by kind, then start."""
    out = []
    raw = text.encode("utf-8", "surrogatepass")
    digits = len(raw.translate(None, b"0123456789")) < len(raw)
    for k, kind in enumerate(KINDS):
        if ("@" in text) if kind == "email" else digits and (kind != "phone" or "+" in text):
            if kind == "email":
                out += [(k, *m) for m in _emails(text)]
            else:
                pattern = _IP if kind == "ip" else PATTERNS[kind]
                out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, but read from each @ outwards: a long text without one costs nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := PATTERNS["email"].match(text, start)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Merged stretches of text within REACH of an anchor."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[int]:
    """Starts of the windows that cover a stretch; the last may reach beyond it."""
    return list(range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE))


def padded(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([ids, np.full(WINDOW - len(ids), tagger.PAD, np.int16)])


def tags_of(spans: list[tuple[int, int, int]], a: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.int8)
    for k, s, e in spans:
        if s < a + n and e > a:
            out[max(s - a, 0) : e - a] = 2 + 2 * k
            if s >= a:
                out[s - a] = 1 + 2 * k
    return out


#: Invented surroundings for made-up spans.
_FILLER = "write to call me at the office ask about contact reach tel mail card paid with server host log from the in und der les de que for our team now today please and then see send it is my address since May he knows more list or try instead rest again up came was seen blocked use number old they took left ring until after lunch works ok dial twice any time us by come us".split()


def _with_luhn(rng: np.random.Generator, n: int) -> str:
    """n digits that pass the check."""
    body = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _spoken(rng: np.random.Generator, a: int, b: int) -> str:
    """a to b letters that can be spoken."""
    first = int(rng.integers(2))
    draws = rng.integers(0, 16, int(rng.integers(a, b + 1)))
    return "".join("aeiouaeioeaieyou"[d] if (i + first) % 2 else "bcdfghklmnprstvw"[d] for i, d in enumerate(draws.tolist()))


def _made(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of a kind in one of the ways people write it; kind -1: what looks like one and isn't."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, n))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    some = lambda a, b: w(int(rng.integers(a, b + 1))) if rng.random() < 0.25 else _spoken(rng, a, b)
    if kind == 0:
        end = pick("com", "org", "net", "de", "co", "io", "fr", "edu")
        name = pick(some(2, 9), f"{some(1, 6)}.{some(3, 8)}", f"{some(2, 6)}_{some(2, 6)}", f"{some(3, 6)}.{d(2)}", f"{some(3, 6)}+{some(2, 4)}", f"{some(3, 6)}{d(2)}")
        host = pick(some(3, 9), f"{some(3, 6)}{d(1)}", f"{some(3, 6)}-{some(3, 5)}", f"{some(3, 5)}.{some(3, 7)}")
        at = pick("@", " @ ", " at ", " at ", " at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", "\uFF20")
        if at in ("@", "\uFF20") and rng.random() < 0.7:
            return f"{name}{at}{host}.{end}"
        dot = pick(".", " . ", " dot ", " dot ", " [dot] ", "[dot]", "(dot)", " DOT ")
        return (name.replace(".", dot) if "dot" in dot.lower() and rng.random() < 0.5 else name) + at + host.replace(".", dot) + dot + end
    if kind == 1:
        if rng.random() < 0.15:  # the longer form
            h = lambda: f"{int(rng.integers(0, 65536)):x}"
            return pick(":".join(h() for _ in range(8)), f"{h()}:{h()}:{h()}::{h()}", f"2001:db8:{h()}::{h()}:{h()}", f"fe80::{h()}:{h()}:{h()}")
        n = lambda: str(int(rng.integers(0, 256)))
        return pick(".", ".", ".", " . ", "[.]", " . ", " dot ", "(.)").join([n(), n(), n(), n()])
    if kind == 2:
        c = _with_luhn(rng, 16)
        return pick(c, " ", "-", ".", " . ", "  ", " - ", "/", "_").join([c[:4], c[4:8], c[8:12], c[12:]]) if rng.random() < 0.75 else (lambda a, sep: sep.join([a[:4], a[4:10], a[10:]]))(_with_luhn(rng, 15), pick(" ", "-", ".", "")) if rng.random() < 0.6 else c
    if kind == 3:
        if rng.random() < 0.15:
            return pick(" ", "-").join(pick(*DIGIT_WORDS, "oh") for _ in range(int(rng.integers(7, 12))))
        a = f"{int(rng.integers(2, 10))}{d(2)}"
        return pick(f"+{d(1)} ({a}) {d(3)}-{d(4)}", f"+{d(2)} {a} {d(7)}", f"+{d(2)}-{a}-{d(4)}", f"({a}) {d(3)}-{d(4)}", f"({a}) {d(3)}-{d(4)}", f"({a}){d(3)}-{d(4)}", f"({a}) {d(3)} {d(4)}", f"{a}-{d(3)}-{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}", f"{a} {d(3)} {d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(6)}", f"0{d(2)} {d(8)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"1-{a}-{d(3)}-{d(4)}", f"0{d(3)}-{d(7)}")
    hexes = lambda n: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))
    return pick(
        f"20{d(2)}-{d(2)}-{d(2)}", f"19{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"20{d(2)}/{d(2)}/{d(2)}", f"19{d(2)}-20{d(2)}",
        f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(2)}", f"{d(2)}:{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"${d(2)}.{d(2)}", f"{d(2)} %", f"{d(2)}.{d(4)}, {d(2)}.{d(4)}",
        d(1), d(2), d(3), d(4), d(5), d(6), d(8), d(12), f"#{d(6)}", f"No. {d(4)}", f"{d(3)}-{d(3)}", f"{d(2)}-{d(2)}", f"pages {d(3)}-{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{w(2).upper()}-{d(4)}-{d(3)}",
        f"{w(3)}{d(2)}", f"{w(18)}={d(3)}{w(2)}{d(8)}", hexes(32), hexes(40), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"@{some(4, 8)}", f"at {some(3, 7)}", f"{some(3, 7)} at the {some(3, 7)}", f"{some(3, 7)} at {some(3, 7)}. {some(2, 5)}", f"at {d(2)}:{d(2)}", f"at {d(3)} {some(3, 6)}", f"{pick(*DIGIT_WORDS)} {pick(*DIGIT_WORDS)}", f"{pick(*DIGIT_WORDS)} or {pick(*DIGIT_WORDS)} {some(3, 7)}", f"{some(3, 6)}.{some(3, 6)}.com/{d(3)}", f"{d(1)} {d(1)} {d(1)} {d(1)}", f"{d(2)} {d(2)} {d(2)}",
    )


def made_windows(n: int, seed: int = 11, plain: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up spans and of what looks like them, between words of plain (texts without spans) or invented ones."""
    rng = np.random.default_rng(seed)
    own = [w for w in (p.split() for p in plain or []) if len(w) > 2]
    ids, tags = np.full((n, WINDOW), tagger.PAD, np.int16), np.zeros((n, WINDOW), np.int8)

    def around() -> str:
        k = int(rng.integers(1, 6))
        if own and rng.random() < 0.6:
            w = own[int(rng.integers(len(own)))]
            at = int(rng.integers(1, len(w)))
            return " ".join(w[at : at + k])
        return " ".join(_FILLER[j] if rng.random() < 0.7 else _spoken(rng, 2, 8) for j in rng.integers(0, len(_FILLER), k))

    for i in range(n):
        text, spans = "", []
        bare = rng.random() < 0.2  # a short text, or the beginning of one
        skip = 0 if bare else int(rng.integers(0, 24))  # a window may begin anywhere
        most = int(rng.integers(20, WINDOW)) if bare and rng.random() < 0.6 else WINDOW + skip
        while len(text) < most:
            kind = int(pick_one(rng, -1, -1, -1, 0, 0, 0, 1, 2, 3, 3))
            if not (bare and not text):
                text += around() + (" " if rng.random() < 0.7 else pick_one(rng, ": ", " <", ' "', " (", ", ", ". ", " tel. ", " Phone: ", " mail ", " Email: ", " no. ", " IP "))
            found = _made(rng, max(kind, -1))
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(found)))
            text += found + (" " if rng.random() < 0.7 else pick_one(rng, ", ", ". ", "\n", "> ", '" ', "; ", "!! "))
        if bare and most < WINDOW:
            text = text.rstrip()
        part = text[skip : skip + WINDOW]
        ids[i] = padded(tagger.encode(part))
        tags[i] = tags_of(spans, skip, WINDOW)
    return ids, tags


def pick_one(rng: np.random.Generator, *choices):
    return choices[int(rng.integers(len(choices)))]


def thresholds(model: tagger.Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[list[float], list[float]]:
    """For each kind, the least probability down to which PRECISION of the windows' findings are right (they overlap a
    labelled span of that kind by four fifths of both), and the share of labelled spans that these are. Spans at a window's ends
    don't count."""
    if not len(ids):
        return [1.1] * len(KINDS), [0.0] * len(KINDS)
    em = model.emissions(ids)
    lengths = np.full(len(ids), WINDOW)
    alpha, beta, logz = model.sums(em, lengths)
    found: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    wanted = [0] * len(KINDS)
    inner = lambda s, e: s > 2 and e < WINDOW - 2
    for r, path in enumerate(model.decode(em, lengths)):
        gold = tagger.spans_of(tags[r])
        for k, s, e in gold:
            wanted[k] += inner(s, e)
        for k, s, e in tagger.spans_of(path):
            if inner(s, e):
                right = any(k == g and min(e, b) - max(s, a) >= 0.8 * max(e - s, b - a) for g, a, b in gold)
                found[k].append((model.span_probability(em[r], alpha[:, r], beta[:, r], logz[r], s, e, 1 + 2 * k), right))
    least, recall = [], []
    for k, rows in enumerate(found):
        rows.sort(reverse=True)
        right = np.cumsum([ok for _, ok in rows]) if rows else np.zeros(0)
        good = np.flatnonzero(right / np.arange(1, len(rows) + 1) >= PRECISION) if rows else np.zeros(0, int)
        least.append(rows[good[-1]][0] if len(good) else 1.1)
        recall.append(float(right[good[-1]] / max(wanted[k], 1)) if len(good) else 0.0)
    return least, recall


@dataclass
class Finder:
    """The network, and for each kind the least probability of a span that counts and the held-out share that this finds."""

    model: tagger.Tagger
    least: list[float]
    recall: list[float]


def fitted(ids: np.ndarray, tags: np.ndarray, plain: list[str], made: int = MADE_WINDOWS) -> Finder:
    """A network fitted on labelled windows and made-up ones; every eighth of both is held out for the thresholds."""
    made_ids, made_tags = made_windows(made, plain=plain)
    ids, tags = np.concatenate([made_ids, ids]), np.concatenate([made_tags, tags])
    held = np.arange(len(ids)) % 8 == 7
    model = tagger.fit(ids[~held], tags[~held], TAGS)
    return Finder(model, *thresholds(model, ids[held], tags[held]))


def fit(docs: DataFrame) -> Finder:
    """Fit on the labelled spans of a bounded sample (SAMPLE_DOCS documents by id hash, SAMPLE_WINDOWS windows) and on
    made-up windows, which also hold ways of writing that the patterns miss."""
    session(docs.sparkSession)
    rows = id_text(docs)
    rows = rows.join(F.broadcast(sample_ids(rows, SAMPLE_DOCS)), "doc_id")  # at most SAMPLE_DOCS rows

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "at": [], "part": [], "tags": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text)
            for a, b in neighbourhoods(text):
                for s in windows(a, b):
                    part = text[s : s + WINDOW]
                    if not any(not any(x < s + m.end() and y > s + m.start() for _, x, y in spans) for m in _LONG_NUMBER.finditer(part)):
                        out["doc_id"].append(doc), out["at"].append(s), out["part"].append(part), out["tags"].append(tags_of(spans, s, WINDOW).tobytes())
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("part", pa.string()), ("tags", pa.binary())]))

    found = map_batches(rows, labelled, "doc_id long, at long, part string, tags binary").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "part").limit(SAMPLE_WINDOWS).collect()
    ids = np.array([padded(tagger.encode(r.part)) for r in found], np.int16).reshape(-1, WINDOW)
    tags = np.array([np.frombuffer(r.tags, np.int8) for r in found], np.int8).reshape(-1, WINDOW)
    return fitted(ids, tags, [r.part for r, t in zip(found, tags, strict=True) if not t.any()])


#: Numbers that may be a card's or a phone's; where no pattern takes one, a window isn't sure to be labelled right.
_LONG_NUMBER = re.compile("[0-9]{13,}")


def _plausible(kind: int, found: str) -> bool:
    digits = "".join(c for c in found if c in "0123456789")
    if kind == 0:
        return len(found) >= 6 and bool(re.search(r"@|\uFF20|(?<![a-z])at(?![a-z])", found, re.IGNORECASE)) and bool(re.search(r"\.|dot", found, re.IGNORECASE))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return found.count(":") >= 3 if ":" in found else len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) + len(re.findall(_DIGIT_WORD, found, re.IGNORECASE)) <= 15 and "@" not in found


def model_spans(finder: Finder, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each text. Texts are read in groups of bounded length, so that many long ones that are
    full of digits don't fill the memory."""
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
            size += len(texts[end])
            end += 1
        out += _model_spans(finder, texts[at:end])
        at = end
    return out


def _model_spans(finder: Finder, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Windows' tag scores are averaged, the middle of a window counting most, each stretch is decoded as a whole, and a
    decoded span counts if its probability over all tag sequences of the stretch is high enough for its kind."""
    model = finder.model
    stretches = [(i, a, b) for i, t in enumerate(texts) for a, b in neighbourhoods(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
    pieces, where, filled = [], [], 0
    total = sum(b - a for _, a, b in stretches)
    sums, weights = np.zeros((total, TAGS), np.float32), np.zeros(total, np.float32)

    def add() -> None:
        em = model.emissions(np.stack(pieces))
        for e, (at, n) in zip(em, where, strict=True):
            sums[at : at + n] += e[:n] * weight[:n, None]
            weights[at : at + n] += weight[:n]
        pieces.clear(), where.clear()

    offsets = []
    for i, a, b in stretches:
        offsets.append(filled)
        codes = tagger.encode(texts[i][a:b])
        for s in windows(0, b - a):
            part = codes[s : s + WINDOW]
            pieces.append(padded(part))
            where.append((filled + s, len(part)))
            if len(pieces) == 512:
                add()
        filled += b - a
    if pieces:
        add()
    sums /= np.maximum(weights, 1e-9)[:, None]
    order = sorted(range(len(stretches)), key=lambda j: stretches[j][2] - stretches[j][1])
    at = 0
    while at < len(order):  # stretches of like length together, within a bounded size
        longest = stretches[order[at]][2] - stretches[order[at]][1]
        end = at
        while end < len(order) and end - at < 256 and (n := stretches[order[end]][2] - stretches[order[end]][1]) <= 2 * longest and (end - at + 1) * n <= 400_000 or end == at:
            end += 1
        group = order[at:end]
        lengths = np.array([stretches[j][2] - stretches[j][1] for j in group])
        em = np.zeros((len(group), lengths.max(), TAGS), np.float32)
        for r, j in enumerate(group):
            em[r, : lengths[r]] = sums[offsets[j] : offsets[j] + lengths[r]]
        paths = model.decode(em, lengths)
        some = np.array([r for r, path in enumerate(paths) if path.any()], np.int64)
        if len(some):
            alpha, beta, logz = model.sums(em[some], lengths[some])
        for q, r in enumerate(some.tolist()):
            i, a, _ = stretches[group[r]]
            n = lengths[r]
            for k, s, e in tagger.spans_of(paths[r]):
                if model.span_probability(em[r, :n], alpha[:n, q], beta[:n, q], logz[q], s, e, 1 + 2 * k) < finder.least[k]:
                    continue
                while e > s and texts[i][a + e - 1] in ".,;:!? \n":  # a sentence's end isn't part of it
                    e -= 1
                if _plausible(k, texts[i][a + s : a + e]):
                    out[i].append((k, a + s, a + e))
        at = end
    return out


def all_spans(model: Finder | None, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(the patterns' spans, all spans) of each text; the network adds those that touch none of the patterns'."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    return [(b, sorted(b + [x for x in m if not any(x[1] < e and s < x[2] for _, s, e in b)])) for b, m in zip(base, model_spans(model, texts), strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: Finder | None) -> DataFrame:
    """doc_id, the patterns' counts by kind, base_sha256 of their spans and all spans."""
    session(docs.sparkSession)

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(model, batch.column(1).to_pylist())
        counts = [pa.array([sum(k == i for k, *_ in b) for b, _ in found], pa.int64()) for i in range(len(KINDS))]
        digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(a) for _, a in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_batches(id_text(docs), scanned, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, model: Finder | None) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.
    Null texts stay null; n_chars, where docs has it, is the new text's length; other columns stay."""
    session(docs.sparkSession)
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = all_spans(model, [t or "" for t in texts])
        out = []
        for t, (_, spans) in zip(texts, found, strict=True):
            parts, last = [], 0
            for s, e, k in sorted((s, e, k) for k, s, e in spans):
                if s >= last:
                    parts += [t[last:s], f"<{KINDS[k].upper()}>"]
                last = max(last, e)
            out.append(t if t is None or not parts else "".join(parts) + t[last:])
        columns = list(batch.columns)
        columns[at] = pa.array(out, pa.string())
        if chars >= 0:
            kind = batch.column(chars).type
            columns[chars] = pa.array([n if a == b else len(b) for n, a, b in zip(batch.column(chars).to_pylist(), texts, out, strict=True)], kind)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(spread(docs), masked, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
