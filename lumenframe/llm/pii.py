"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four fixed patterns over the whole text (see ``base_spans``).
The field then looks at every number-like or address-like candidate of a document:

* nodes: base spans (clamped to their kind) and further candidates, in text order;
* chain edges join neighbouring nodes at most ``REACH`` characters apart;
* skip edges join a node to the next one with the same key, however distant: all
  digits, the last seven digits, the address in lower case, its local part;
* potentials: features of the node's form and of the word before it, a label pair
  table for chain edges and one for skip edges.

Loopy belief propagation (damped, parallel) gives each node's marginal. A candidate
becomes a span if its best label is a kind with a probability of at least
``MIN_PROBABILITY`` and skip edges connect it to a base span: the method makes
labels consistent inside a document and invents none in a document without any.

Weights are fitted on the driver by pseudo-likelihood, whose labels are the base
spans (candidates that skip edges tie to one are left out, their label is the open
question), on a sample of at most ``sample_rows`` documents that hold a digit or an at
sign, picked by a hash of id and text. Only this fit is bounded; every document is
searched whole.

Defined results: null or empty texts have no spans; if nothing can be fitted the
prior weights stand; offsets count code points, ends are exclusive. Documents are
independent rows: no exchange besides the pick of the sample. Repeated rows repeat,
extra columns pass through, computed names replace columns of the same name. Very long
texts are worked on whole, in time that grows with their length. The counts n_email,
n_ip, n_card and n_phone take all spans, base ones and added ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import hex_sha256, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: The sample that the weights are fitted on.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
REACH = 40
ROUNDS = 12
DAMPING = 0.3
MIN_PROBABILITY = 0.9
#: Prior means of the diagonal of the two pair tables.
CHAIN_PRIOR, SKIP_PRIOR = 0.2, 6.0

DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates beyond the base: number-like runs, and addresses spelled with other marks.
NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20/-]{5,}[0-9]")
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]+)*")
MAYBE_ADDRESS = re.compile(r"@|[\[({]at[\])}]")
DIGIT = re.compile(r"[0-9]")
CUES = {
    "email": ("mail", "email", "e-mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "telefono", "téléphone"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of an address, found from each at sign
    outward: every character is read a fixed number of times, however long a run is."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of four dotted runs of digits; only the first
    digit of a run can begin one, as any later one would fail or match like it."""
    last = 0
    for run in DIGITS.finditer(text):
        if run.start() >= last:
            m = IP.match(text, run.start())
            if m:
                yield m.span()
                last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and then start. Matches are leftmost and do not
    overlap within a kind; failing matches are dropped without another try."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if not DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out += [(1, s, e) for s, e in _ips(text) if _is_ip(text[s:e])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label or -1, start, end) of base spans and further candidates, by start."""
    taken = sorted((s, e, k + 1) for k, s, e in base)
    covered, last = [], -1
    for s, e, k in taken:  # base spans of different kinds may overlap: the first is the node
        if s >= last:
            covered.append((k, s, e))
            last = e
    extra = []
    if MAYBE_ADDRESS.search(text):
        extra += [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
    if DIGIT.search(text):
        extra += [(m.start(), m.end()) for m in NUMBER.finditer(text) if sum(map(str.isdigit, m.group())) >= 7]
    free, i = [], 0
    for s, e in sorted(extra):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        clash = any(b < e and s < c for b, c, _ in taken[max(0, i - 4) : i + 8])
        if not clash and (not free or s >= free[-1][2]):
            free.append((-1, s, e))
    return sorted(covered + free, key=lambda x: x[1])


N_FEATURES = 13


def features(text: str, start: int, end: int) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    n = len(digits)
    before = re.findall(r"\w[\w-]*", text[max(0, start - 24) : start].lower())[-2:]
    x[0] = 1
    x[1] = "@" in span or bool(re.search("[a-zA-Z]{3}", span))
    x[2] = span.count(".") == 3 and bool(IP.fullmatch(span)) and _is_ip(span)
    x[3] = 7 <= n <= 8
    x[4] = 9 <= n <= 12
    x[5] = 13 <= n <= 15
    x[6] = 16 <= n <= 19
    x[7] = n >= 13 and luhn(digits)
    x[8] = bool(re.search(r"[() -]", span))
    for i, kind in enumerate(KINDS):
        x[9 + i] = any(w in CUES[kind] for w in before)
    return x


def keys_of(text: str, start: int, end: int) -> list[str]:
    """Nodes with a key in common are the same thing or alike."""
    span = text[start:end].lower()
    digits = re.sub(r"[^0-9]", "", span)
    if re.search("[a-z]{2}", span):
        plain = re.sub(r"\s*[\[({]at[\])}]\s*", "@", re.sub(r"\s*[\[({]dot[\])}]\s*", ".", span)).strip(".-")
        return ["a:" + plain, "l:" + plain.split("@")[0]] if "@" in plain else []
    if span.count(".") == 3 and IP.fullmatch(span):
        return ["i:" + span]
    return (["d:" + digits] if len(digits) >= 7 else []) + (["s:" + digits[-7:]] if len(digits) >= 9 else [])


def graph(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges; each skip edge goes to the next node with the key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][1] - nodes[i][2] <= REACH]
    last: dict[str, int] = {}
    skip = set()
    for i, (_, s, e) in enumerate(nodes):
        for key in keys_of(text, s, e):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip)


def prior() -> dict[str, np.ndarray]:
    k = len(LABELS)
    unary = np.zeros((N_FEATURES, k))
    unary[0, 0] = 1.0
    unary[1, 1] = unary[2, 2] = unary[7, 3] = unary[4, 4] = 1.5
    return {"unary": unary, "chain": np.eye(k) * CHAIN_PRIOR, "skip": np.eye(k) * SKIP_PRIOR}


def fit(texts: list[str], *, steps: int = 150, rate: float = 0.5, ridge: float = 0.02) -> dict[str, np.ndarray]:
    """Pseudo-likelihood weights, with a Gaussian prior around ``prior()``."""
    start = prior()
    w = {k: v.copy() for k, v in start.items()}
    xs, ys, chains, skips = [], [], [], []
    k = len(LABELS)
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        chain, skip = graph(text, nodes)
        # what skip edges tie to a base span is the open question, not an example of "other"
        tied = {i for a, b in skip for i, j in ((a, b), (b, a)) if nodes[i][0] < 0 <= nodes[j][0]}
        labels = [max(n[0], 0) for n in nodes]
        around = np.zeros((2, len(nodes), k))
        for which, edges in enumerate((chain, skip)):
            for a, b in edges:
                if a not in tied and b not in tied:
                    around[which, a, labels[b]] += 1
                    around[which, b, labels[a]] += 1
        for i, (_, s, e) in enumerate(nodes):
            if i not in tied:
                xs.append(features(text, s, e))
                chains.append(around[0, i])
                skips.append(around[1, i])
                ys.append(labels[i])
    if not ys:
        return w
    x, c, s = np.array(xs), np.array(chains), np.array(skips)
    y = np.eye(k)[ys]
    n = len(ys)
    for _ in range(steps):
        z = x @ w["unary"] + c @ w["chain"] + s @ w["skip"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        err = (y - p) / n
        for name, seen in (("unary", x), ("chain", c), ("skip", s)):
            step = seen.T @ err - ridge * (w[name] - start[name])
            if name != "unary":
                step = (step + step.T) / 2  # pair tables are symmetric
            w[name] += rate * step
    return w


def marginals(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Loopy belief propagation. unary: log potentials (nodes, labels); edges: (m, 2);
    tables: (m, labels, labels) log potentials, by first and second node."""
    n, k = unary.shape
    m = len(edges)
    if not m:
        b = unary
    else:
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            b = unary.copy()
            np.add.at(b, dst, messages)
            out = b[src] - messages[back]
            new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            messages = DAMPING * messages + (1 - DAMPING) * new
        b = unary.copy()
        np.add.at(b, dst, messages)
    b = b - b.max(1, keepdims=True)
    p = np.exp(b)
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], w: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """The spans that the field adds to the base."""
    if not base:
        return []
    nodes = nodes_of(text, base)
    if all(n[0] >= 0 for n in nodes):
        return []
    chain, skip = graph(text, nodes)
    linked, todo = set(), [i for i, n in enumerate(nodes) if n[0] >= 0]
    near: dict[int, list[int]] = {}
    for a, b in skip:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    while todo:
        i = todo.pop()
        if i not in linked:
            linked.add(i)
            todo += near.get(i, [])
    if not any(nodes[i][0] < 0 for i in linked):
        return []
    unary = np.array([features(text, s, e) for _, s, e in nodes]) @ w["unary"]
    for i, (label, *_) in enumerate(nodes):
        if label >= 0:
            unary[i] = -50.0
            unary[i, label] = 0.0
    edges = np.array(chain + skip, dtype=int).reshape(-1, 2)
    tables = np.concatenate([np.repeat(w["chain"][None], len(chain), 0), np.repeat(w["skip"][None], len(skip), 0)])
    p = marginals(unary, edges, tables)
    out = []
    for i, (label, s, e) in enumerate(nodes):
        best = int(p[i].argmax())
        if label < 0 and i in linked and best and p[i, best] >= MIN_PROBABILITY:
            out.append((best - 1, s, e))
    return out


def fit_on(df: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Weights fitted on at most ``sample_rows`` documents with a digit or an at sign, each
    of ``SAMPLE_CHARS`` code points at most, so that the sample's bytes are bounded too."""
    able = df.filter(F.char_length(text_col) <= SAMPLE_CHARS).filter(F.col(text_col).rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]"))
    hashed = able.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    n = able.count()
    if n > 4 * sample_rows:  # about four times as many by hash, so that few rows meet in the pick
        hashed = hashed.filter(F.pmod("h", F.lit(10**12)) < 4 * sample_rows * 10**12 // n)
    picked = hashed.orderBy("h", "t").limit(sample_rows)
    return fit([r["t"] for r in picked.toLocalIterator()])


def find(df: DataFrame, weights: dict[str, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """Replace ``text_col`` by ``spans``, array<struct<kind, start, stop, base>>, by kind
    (as in KINDS) and then start; ``base`` tells the patterns' spans from the field's."""
    rest = df.drop("spans")
    at = rest.columns.index(text_col)
    kept = [f for f in rest.schema.fields if f.name != text_col]
    item = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
    schema = T.StructType([*kept, T.StructField("spans", T.ArrayType(item))])
    plain = {k: v.tolist() for k, v in weights.items()}

    def spans(text: str | None, w: dict[str, np.ndarray]) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        more = added_spans(text, base, w)
        every = sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more])
        return [{"kind": KINDS[k], "start": s, "stop": e, "base": b} for k, s, e, b in every]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {k: np.array(v) for k, v in plain.items()}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found = pa.array([spans(t.as_py(), w) for t in batch.column(at)], kind)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, found], [*(f.name for f in kept), "spans"])

    return rest.mapInArrow(run, schema)


def listed(spans):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit_on(docs))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": number(k) for k in KINDS}
    base = F.filter("spans", lambda s: s["base"])
    return found.withColumns(counts).select(
        "doc_id", *counts, hex_sha256(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
