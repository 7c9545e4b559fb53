"""Secret scan: fixed patterns, and strings that stay incompressible against the text around them."""
import hashlib
import re
from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import small_batches

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"pass|secret|token|key|credential|bearer|auth|private", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIERS = b"password passwd secret token api_key apikey access_key client_secret private_key authorization bearer config settings username localhost example default return import function class const export string value true false null none http https www com org net "
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
KINDS = ("assign", "access", "hex")


def novelty(candidate: str, context: str, names: str = "", level: int = 3) -> float:
    """Marginal compressed bytes of candidate per byte, the compressor primed with identifiers, those of the file, and the context."""
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + f"{names} {context}".encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=level, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)
    data = candidate.encode()
    return (len(press.compress(data)) - len(press.compress(b""))) / len(data)


def repeated_names(text: str, most: int = 4000) -> str:
    """Identifiers that a text uses more than once, the most frequent first (ties by name), ``most`` signs in all."""
    counts = Counter(NAME.findall(text))
    out, size = [], 0
    for _, x in sorted((-n, x) for x, n in counts.items() if n > 1):
        size += len(x) + 1
        if size > most:
            break
        out.append(x)
    return " ".join(out)


def scan(text: str, around: int = 200, least: float = 0.85, near: int = 2000) -> tuple[list, list]:
    """(base spans, all spans). A candidate off the base spans is tested where a sensitive word stands before it.

    The compressor knows the identifiers that the file repeats, those once within ``near`` signs that the candidate
    doesn't hold, and the text ``around`` it: as much for each candidate, however long the file."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, names, k, end = [], None, 0, -1
    for m in CANDIDATE.finditer(text):
        s, a, b = m[0], m.start(), m.end()
        # Base spans that begin before the candidate ends, and how far they reach.
        while k < len(base) and base[k][0] < b:
            end = max(end, base[k][2])
            k += 1
        if end > a:
            continue
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        if mixed and SENSITIVE.search(text, max(0, a - 40), a):
            if names is None:
                names = repeated_names(text)
            once = " ".join(x for x in dict.fromkeys(NAME.findall(text[max(0, a - near):a] + " " + text[b:b + near])) if x not in s)
            if novelty(s, text[max(0, a - around):a] + " " + text[b:b + around], f"{once} {names}") >= least:
                found.append((a, 3, b))
    return base, sorted(base + found)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text (null: empty): base kinds, and off these 'novel' ones by the compressor.

    Every row gives one row; empty texts have no spans; ties at one start go by kind; repeated rows stay; an empty
    table gives an empty result; other columns are ignored. Offsets are code points.
    """
    def run(batches):
        name = (*KINDS, "novel")
        say = lambda spans: ",".join(f"{name[k]}:{a}:{b}" for a, k, b in spans)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                base, spans = scan(text or "")
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, schema)
