"""Operator 3: secret scans.

An Aho-Corasick automaton finds keywords; regular expressions are anchored
only at its hits; kinds with an embedded checksum are kept only where it holds.

Base kinds: ``assign`` (name = value), ``access`` (access key ids) and ``hex``
(long hexadecimal runs; every three hexadecimal digits are a keyword, so a hit
lies in each run). Further kinds, all with a checksum or a decodable frame:
``crc_token`` (prefix_ + 30 characters + base-62 CRC-32 of them), ``wif``
(base58check private key), ``jwt`` (header that decodes to a JSON object).

Defined results: a null text is an empty text; no hits give zeros, the digest
of the empty string and empty spans. Rows are handled one by one, so copies
give equal rows; other columns are ignored. Spans are in code points.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import arrow_map, read_table

KINDS = ("assign", "access", "hex", "crc_token", "wif", "jwt")
HEX = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")


def _either_case(words: str) -> str:
    """Letters in either case, ASCII only (re.IGNORECASE would also take the long s and the kelvin sign)."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = re.compile(f"({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX_RUN = re.compile("[0-9a-f]+")
CRC_TOKEN = re.compile("(?:gh[opusr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WIF = re.compile(f"(?<![{BASE58}])[5KL][{BASE58}]{{50,51}}(?![{BASE58}])")
#: A private key starts with one of these, which follow from its version byte.
WIF_STARTS = ("5h", "5j", "5k", *(a + b for a in "kl" for b in "12345wxyz"))
JWT_RUN = re.compile("[A-Za-z0-9_-]*")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = dict.fromkeys(NAMES, "assign") | {"akia": "access", "eyj": "jwt"} | dict.fromkeys(CRC_PREFIXES, "crc_token") | dict.fromkeys(WIF_STARTS, "wif")
    words |= {"".join(x): "hex" for x in itertools.product(HEX, repeat=3)}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def crc_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0") == check


def wif_holds(text: str) -> bool:
    """base58check: the last four bytes are the head of the double SHA-256 of the rest."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    try:
        raw = n.to_bytes(38 if text[0] != "5" else 37, "big")
    except OverflowError:
        return False
    return raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def jwt_holds(head: str) -> bool:
    """Whether the header decodes to an object; one nested deeper than the parser goes doesn't."""
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed."""
    # the dotted capital I is the only letter whose lower case has another length
    hits = automaton().iter(text.replace("İ", "I").lower())
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    pending: list[tuple[int, str]] = []
    for end, (kind, length) in hits:
        start = end + 1 - length
        if kind == "hex":
            if end < done["hex"]:
                continue
            while start > done["hex"] and text[start - 1] in HEX:
                start -= 1
            m = HEX_RUN.match(text, start)
            if m is None or m.end() <= end:
                continue  # capitals
            done["hex"] = m.end()
            if m.end() - m.start() >= 24:
                out.append((m.start(), m.end(), "hex"))
        else:
            pending.append((start, kind))
    for start, kind in sorted(pending):
        if start < done[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "crc_token": CRC_TOKEN, "jwt": JWT, "wif": WIF}[kind].match(text, start)
        if m is None:
            if kind == "jwt":  # no start in the same run has the dots that this one lacks
                done[kind] = JWT_RUN.match(text, start).end()
            continue
        done[kind] = m.end()
        if kind == "assign" and len(m[2]) < 6 or kind == "access" and m.end() - start < 20 or kind == "crc_token" and not crc_holds(m[1], m[2]) or kind == "jwt" and not jwt_holds(m[1]) or kind == "wif" and not wif_holds(m[0]):
            continue
        out.append((start, m.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of every whole text."""

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            spans = scan(text or "")
            base = [s for s in spans if s[2] in KINDS[:3]]
            n = [sum(s[2] == k for s in spans) for k in KINDS[:3]]
            yield i, *n, len(spans) - len(base), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_spans(read_table(spark, sf_dir, "documents"))
