"""Redaction of absolute paths, network addresses and host names in free text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a token: white space, quotes, and signs that no file name holds.
ENDS = r"\s\"'`<>|?*\x00-\x1f"
#: Where a token may begin: at the text's start, behind white space, quotes, brackets and a few signs.
_WORD = r"(?:(?<![\s\S])|(?<=[\s\"'`(\[{=,;|>]))"
#: Behind an escaped line end or tab, as logs hold them.
_ESCAPE = r"(?:(?<=\\[ntr])(?<!\\\\[ntr]))"
_GLUE, _STARS, _PROSE = r"(?<=:)", r"(?<=\*\*)", r"(?<=[^\x00-\x7f])"
_LOOSE = rf"(?:{_WORD}|{_ESCAPE}|{_PROSE}|{_GLUE}|{_STARS})"
#: Addresses that lead to files.
SCHEMES = ("file:", "smb://", "nfs://", "afp://", "cifs://")

_TOKEN = re.compile(rf"(?:\\\\\?\\)?(?:[^{ENDS},;]|[,;](?=\S))*")
_FLAT = re.compile(r"[A-Za-z0-9_.\-]*")


def _token(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def flattened(roots: Sequence[str]) -> list[str]:
    """How known folders, and those above them down to two parts, begin in names that were made from paths."""
    out = set()
    for root in roots:
        parts = [p for p in re.split(r"[/\\]", root) if p not in ("", ".")]
        lead = "__" if root.startswith(("//", "\\\\")) else "_" if root.startswith("/") else None
        if lead is not None and ".." not in parts:
            out |= {re.sub(r"[^A-Za-z0-9_-]", "_", lead + "_".join(parts[:n])) for n in range(2, len(parts) + 1)}
    return sorted(out, key=lambda r: (-len(r), r))


def _starts(roots: Sequence[str]) -> re.Pattern:
    """One alternative for each shape of a beginning; known roots from the longest down."""
    names = "|".join([r"[A-Za-z]__(?=[A-Za-z0-9])", *[rf"(?i:{re.escape(r)})(?![A-Za-z0-9])" for r in flattened(roots)]])
    shapes = {
        "url": rf"{_LOOSE}(?i:{'|'.join(map(re.escape, SCHEMES))})(?=[^{ENDS}])",
        "unc": rf"{_LOOSE}(?<!\\)\\\\(?=[A-Za-z0-9?.]|[^\x00-\x7f])",
        "drive": rf"(?:{_ESCAPE}|(?<![A-Za-z0-9_.\-/\\]))[A-Za-z]:[\\/]",
        "share": rf"(?:{_WORD}|{_ESCAPE}|{_PROSE}|{_STARS})//(?=[A-Za-z0-9])",
        "path": rf"(?:{_WORD}|{_ESCAPE}|{_GLUE}|{_STARS})(?<!<case>)/(?=[A-Za-z0-9_.~\-$]|[^\x00-\x7f])",
        "prose": rf"{_PROSE}/(?=[A-Za-z0-9_.~\-$]|[^\x00-\x7f])",
        "flat": rf"(?:{_WORD}|{_ESCAPE}|(?<=[/\\]))(?:{names})",
        "home": rf"{_LOOSE}~[\\/](?=[^{ENDS}])",
    }
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in shapes.items()))


def _trimmed(text: str) -> str:
    """Without the signs of the sentence around: stops, and closing brackets that nothing opens."""
    while len(text) > 1 and (text[-1] in ".,:;!" or any(text[-1] == b and text.count(b) > text.count(a) for a, b in ("()", "[]", "{}"))):
        text = text[:-1]
    return text


def _path_at(text: str, at: int) -> str:
    """The path that begins here: a token, and the words behind single blanks that go on with it: those with a separator, and a last word that is a file's name."""
    end = at + len(_trimmed(_TOKEN.match(text, at).group()))
    while end < len(text) and text[end] == " ":
        word = _trimmed(_TOKEN.match(text, end + 1).group())
        last = end + 1 + len(word) == len(text) and re.fullmatch(r".+\.[^.]+", word)
        if not word or not ("/" in word or "\\" in word or last):
            break
        end += 1 + len(word)
    return text[at:end]


class Redactor:
    """Finds paths in texts; `case_roots` are shown as <case>, `roots` are known folders whose flattened names tell of them."""

    def __init__(self, case_roots: Sequence[str] = (), roots: Sequence[str] = ()):
        self.case_roots = sorted({r.rstrip("/\\") for r in case_roots}, key=lambda r: (-len(r), r))
        self.starts = _starts([*roots, *case_roots])

    def text(self, text: str) -> str:
        out, copied, at = [], 0, 0
        while (m := self.starts.search(text, at)) is not None:
            kind, begin = m.lastgroup, m.start()
            if kind == "flat":
                found, token = _trimmed(_FLAT.match(text, begin).group()), "<redacted:{}>"
            elif kind == "url":
                found, token = _trimmed(_TOKEN.match(text, begin).group()), "<redacted-url:{}>"
            else:
                found, token = _path_at(text, begin), "<redacted:{}>"
                first = _trimmed(_TOKEN.match(text, begin).group())
                if (kind == "share" and "/" not in first[2:]) or (kind == "prose" and "/" not in first[1:]):
                    at = begin + 1
                    continue
            shown = self._in_case(found) if kind in ("path", "drive", "prose") else None
            out += [text[copied:begin], shown if shown is not None else token.format(_token(found))]
            copied = at = max(begin + len(found), begin + 1)
        return "".join([*out, text[copied:]])

    def _in_case(self, path: str) -> str | None:
        """<case>/ and the rest of a path below a case's folder, names that tell of other folders left out; null elsewhere, and where the path climbs."""
        for root in self.case_roots:
            if path.startswith(root) and path[len(root) : len(root) + 1] in ("", "/", "\\"):
                parts = [p for p in re.split(r"[/\\]", path[len(root) :]) if p not in ("", ".")]
                if ".." in parts:
                    return None
                named = [f"<redacted:{_token(p)}>" if (m := self.starts.match(p)) and m.lastgroup == "flat" else p for p in parts]
                return "/".join(["<case>", *named])
        return None


def redact(text: Column, case_root: str | None = None, roots: Sequence[str] = ()) -> Column:
    """Each absolute path becomes <redacted:16 hex of its SHA-256>, each address of a file share <redacted-url:...>, the same for the same input.

    A path is one of POSIX, of a drive, of a share, below the home folder, or a file's name that
    was flattened from a path (of a drive, or of the known `roots`). It may stand behind
    punctuation, an escape or prose in another script, and goes on over single blanks. A path
    below `case_root` becomes <case>/ and its rest. Web addresses stay. Null stays null.
    """
    roots = tuple(roots)

    @F.pandas_udf("string")
    def hidden(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Redactor((case_root,) if case_root else (), roots)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else own.text(t))

    return hidden(text)


def host_token(host: Column) -> Column:
    """The token of a host's name, the same for the same name; null for null."""
    return F.concat(F.lit("<redacted-host:"), F.substring(F.sha2(host, 256), 1, 16), F.lit(">"))
