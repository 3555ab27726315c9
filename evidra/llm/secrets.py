"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its surroundings.

A candidate is a run of 16 or more letters, digits and +/_=.-, with or without a digit. Offsets are code points, end
exclusive. Null and empty texts have no spans. Rows are judged one by one: repeated rows have equal results, an empty
table gives an empty result, extra columns don't matter. Candidates of any length are read whole, in overlapping windows
with what stands around them, and judged by the most suspicious one."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import convnet, tagger
from evidra.llm.common import id_text, map_batches, sample_ids, session

#: The kinds, in the order of all results; the network's findings come last.
KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of fewer characters are dropped, so they needn't be found
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Characters of a window of a candidate and of either side of it that the network reads.
BODY, SIDE = 48, 20
LENGTH = BODY + 2 * SIDE
#: Documents whose candidates the network is fitted on, and candidates, at most.
SAMPLE_DOCS, SAMPLE = 3000, 2000
#: Share of labelled findings that the threshold must find.
RECALL = 0.97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the patterns' spans, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(k in raw for k in KEYS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in raw:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if len(raw.translate(None, b"0123456789")) < len(raw) or _LONG_HEX.search(raw):
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


_LONG_HEX = re.compile(rb"[a-f]{32}")


def candidates(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate itself, or windows of BODY characters that cover a longer one, each half over the one before."""
    if end - start <= BODY:
        return [(start, end)]
    return [(at, at + BODY) for at in [*range(start, end - BODY, BODY // 2), end - BODY]]


def view(text: str, start: int, end: int) -> np.ndarray:
    """What the network reads of a window: SIDE characters before, up to BODY of it, SIDE characters after, each padded to
    its own place."""
    pad = lambda ids, n: np.concatenate([ids, np.full(n - len(ids), tagger.PAD, np.int16)])
    before = tagger.encode(text[max(0, start - SIDE) : start])
    return np.concatenate([pad(before[::-1], SIDE)[::-1], pad(tagger.encode(text[start:end]), BODY), pad(tagger.encode(text[end : end + SIDE]), SIDE)])


def made_candidates(n: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Labelled made-up candidates: secrets as common services write them, and harmless strings that look like them."""
    rng = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    s = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: s(low, int(rng.integers(3, 9)))
    ids, y = np.zeros((n, LENGTH), np.int16), np.zeros(n)
    for i in range(n):
        y[i] = i % 2
        if y[i]:
            body = pick(lambda: s(low + up + dig, 40), lambda: "ghp_" + s(low + up + dig, 36), lambda: "sk_live_" + s(low + up + dig, 24), lambda: s("0123456789abcdef", 40), lambda: "AKIA" + s(up + dig, 16), lambda: s(low + up + dig + "+/", 43) + "=", lambda: s("0123456789abcdef", 18), lambda: "xoxb-" + s(dig, 12) + "-" + s(low + up + dig, 24), lambda: s(low + up, int(rng.integers(16, 41))), lambda: s(low + up, 20))()
            left = pick("token = \"", "password=", "key: ", "secret: ", "auth=", "Bearer ", f"{word()} ", f"{word()}_KEY=", "credentials ")
        else:
            body = pick(lambda: f"{word()}.{word()}{s(dig, 1)}.example.com", lambda: "/".join([word(), word(), s(dig, 4), word()]), lambda: s(dig, 16), lambda: f"20{s(dig, 2)}-{s(dig, 2)}-{s(dig, 2)}T{s(dig, 2)}", lambda: f"{word()}_{word()}_{word()}_v{s(dig, 2)}", lambda: f"{word()}-{word()}-{word()}-{s(dig, 3)}", lambda: f"{s(dig, 3)}.{s(dig, 3)}.{s(dig, 3)}.{s(dig, 3)}.{s(dig, 2)}", lambda: s(dig, 20), lambda: f"www.{word()}{word()}.org/{s(dig, 3)}", lambda: "=" * 14 + s(dig, 3), lambda: f"{word()}.{s(dig, 2)}@"[:-1] + word() + word(), lambda: "".join(word() for _ in range(4)), lambda: (word() + word() + word() + word()).capitalize(), lambda: pick("-", "_", ".", "/").join(word() for _ in range(4)), lambda: word() + "".join(word().capitalize() for _ in range(3)), lambda: "".join(word() for _ in range(4)).upper(), lambda: pick("=", "-", ".", "_") * int(rng.integers(16, BODY + 1)))()
            left = pick(f"{word()} ", "see ", "https://", f"{word()}@", "file ", "id ", "on ", f"{word()}, ")
        text = f"{word()} {word()} {word()} {left}"
        ids[i] = view(text + body + pick(" ", "\" ", ". ", "\n", ",") + f"{word()} {word()} {word()}", len(text), len(text) + len(body))
    return ids, y


def fit(docs: DataFrame) -> convnet.ConvNet:
    """Fit on the candidates of a bounded sample (SAMPLE_DOCS documents by id hash, SAMPLE candidates), labelled by the
    patterns' findings, and on as many made-up ones."""
    session(docs.sparkSession)
    rows = id_text(docs)
    rows = rows.join(F.broadcast(sample_ids(rows, SAMPLE_DOCS)), "doc_id")  # at most SAMPLE_DOCS rows

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "at": [], "ids": [], "y": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            for s, e in (w for c in candidates(text) for w in windows(*c)):
                out["doc_id"].append(doc), out["at"].append(s), out["ids"].append(view(text, s, e).astype("<i2").tobytes())
                out["y"].append(int(any(s < b and a < e for _, a, b in base)))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary()), ("y", pa.int32())]))

    found = map_batches(rows, labelled, "doc_id long, at long, ids binary, y int").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "ids").limit(SAMPLE).collect()
    ids, y = made_candidates(max(SAMPLE, len(found)))
    if found:
        ids = np.concatenate([ids, np.array([np.frombuffer(r.ids, "<i2") for r in found], np.int16)])
        y = np.concatenate([y, np.array([r.y for r in found], float)])
    return convnet.fit(ids, y, tagger.N_CHARS, RECALL)


def all_spans(net: convnet.ConvNet, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(the patterns' spans, all spans) of each text; the network adds candidates that touch none of the patterns'."""
    base = [base_spans(t) for t in texts]
    added: list[dict[tuple[int, int, int], None]] = [{} for _ in texts]
    views, whose = [], []

    def judge() -> None:
        for p, (i, s, e) in zip(net.probability(np.stack(views)), whose, strict=True):
            if p >= net.threshold:
                added[i][3, s, e] = None  # once for all windows
        views.clear(), whose.clear()

    for i, t in enumerate(texts):
        for s, e in candidates(t):
            if not any(s < b and a < e for _, a, b in base[i]):
                for w in windows(s, e):
                    views.append(view(t, *w)), whose.append((i, s, e))
                    if len(views) == 1024:
                        judge()
    if views:
        judge()
    return [(b, sorted([*b, *a], key=lambda x: (x[1], x[0]))) for b, a in zip(base, added, strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, net: convnet.ConvNet) -> DataFrame:
    """doc_id, the patterns' counts by kind, base_sha256 of their spans and all spans."""
    session(docs.sparkSession)

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(net, batch.column(1).to_pylist())
        counts = [pa.array([sum(k == i for k, *_ in b) for b, _ in found], pa.int64()) for i in range(3)]
        digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(a) for _, a in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(id_text(docs), scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
