"""Line-first cleaning: rules on lines, then a verdict on the document.

Every line is judged by its punctuation, by whether it is navigation and by
whether it is boilerplate. Lines that fail are taken out; a document that
loses too much of its text that way is rejected. Counts for whole documents
are kept beside.

Defined results: null text is empty text, has no words and fails the base
rules; repeated rows give repeated results; a document exactly at a threshold
is kept; there is no state between rows, so ties and hot sources need no care;
an empty table gives no rows; columns beside id and text, whatever their names,
are ignored; a text of any length is judged whole, in time linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb

_END_MARKS = (b".", b"!", b"?", b'"', b"'", b":", b";", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode())
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SEPARATORS = re.compile(rb"[|\xbb]|\xe2\x80\xa2|\xc2\xb7|>>")
# Words that lead entries of menus, and phrases of boilerplate, in English, German, Spanish and French.
MENU = (
    "home", "menu", "login", "log in", "sign in", "sign up", "search", "contact", "about", "next", "previous", "share", "subscribe", "skip to \\w+",
    "startseite", "menü", "anmelden", "registrieren", "suche", "kontakt", "über uns", "weiter", "zurück", "teilen", "abonnieren", "impressum",
    "inicio", "menú", "iniciar sesión", "registrarse", "buscar", "contacto", "acerca de", "siguiente", "anterior", "compartir", "suscribirse",
    "accueil", "connexion", "s'inscrire", "rechercher", "à propos", "suivant", "précédent", "partager", "s'abonner",
)
BOILERPLATE = (
    "licen[sc]ed under", "all rights reserved", "copyright\\s+(\\(c\\)|©|\\d{4})", "terms (of (use|service)|and conditions)", "privacy policy", "cookie(s| policy)", "enable javascript", "spdx-license", "without warrant(y|ies)",
    "lizenziert unter", "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz(erklärung|hinweise)", "ohne gewähr",
    "bajo (la )?licencia", "todos los derechos reservados", "condiciones de uso", "política de (privacidad|cookies)", "sin garantía",
    "sous licence", "tous droits réservés", "conditions (générales )?d'utilisation", "politique de confidentialité", "mentions légales", "sans garantie",
)
_MENU = re.compile(rb"(?i)^\W*(" + "|".join(MENU).encode() + rb")(?![a-z0-9_\x80-\xff])")
_BOILERPLATE = re.compile(rb"(?i)" + "|".join(BOILERPLATE).encode())
_UPPER = re.compile(rb"[A-Z]")
_LOWER = re.compile(rb"[a-z]")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the line rules and of the verdict.

    A document is rejected that loses over ``most_lost`` of its text, or over
    ``most_junk`` by navigation and punctuation; a licence line in a short
    document thus counts less than a menu.
    """

    min_words: int = 50
    most_repeat_percent: int = 50
    most_symbols_a_word: float = 0.2
    menu_words: int = 6
    separators_a_word: float = 0.2
    shout_marks_a_word: float = 0.3
    bare_words: int = 8
    most_lost: float = 0.4
    most_junk: float = 0.2


def line_fault(line: bytes, limits: Limits) -> str | None:
    """Name of the rule that the line breaks; None for a sound line."""
    words = line.split()
    if not words:
        return None
    n = len(words)
    separators = len(_SEPARATORS.findall(line)) if b"|" in line or b"\xe2" in line or b"\xc2" in line or b">>" in line else 0
    if separators >= 2 and separators >= limits.separators_a_word * n or n <= limits.menu_words and _MENU.match(line) and not line.rstrip().endswith(_END_MARKS):
        return "navigation"
    if len(_SYMBOLS.findall(line)) > limits.most_symbols_a_word * n + 1:
        return "punctuation"
    if line.count(b"!") > limits.shout_marks_a_word * n + 1 and len(_UPPER.findall(line)) > len(_LOWER.findall(line)):
        return "punctuation"
    if n < limits.bare_words and not line.rstrip().endswith(_END_MARKS):
        return "punctuation"
    if n <= 60 and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def _document(text: bytes, limits: Limits) -> tuple[int, int, int, int, int, dict[str, int]]:
    """(n_dup_lines, lost, all, n_lines, n_lost_lines, bytes lost by rule): sizes in bytes of words' lines."""
    seen: set[bytes] = set()
    dup = lost = whole = n_lines = n_lost = 0
    by: dict[str, int] = {}
    for line in text.split(b"\n"):
        bare = line.strip()
        if not bare:
            continue
        n_lines += 1
        whole += len(bare)
        repeated = line in seen
        if repeated:
            dup += 1
        else:
            seen.add(line)
        fault = line_fault(line, limits) or ("boilerplate" if repeated else None)
        if fault:
            lost += len(bare)
            n_lost += 1
            by[fault] = by.get(fault, 0) + len(bare)
    return dup, lost, whole, n_lines, n_lost, by


def cleaned(text: str | None, limits: Limits = Limits()) -> str:
    """The text without the lines that break a rule."""
    seen: set[bytes] = set()
    kept = []
    for line in (text or "").encode().split(b"\n"):
        if line.strip() and (line in seen or line_fault(line, limits)):
            continue
        seen.add(line)
        kept.append(line)
    return b"\n".join(kept).decode()


def _counts(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, code points in words, words in repeated 3-word windows) of each row."""
    n = len(limits) - 1
    starts, ends, rows = tb.word_spans(data, limits)
    words = np.bincount(rows, minlength=n)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = np.bincount(rows, weights=points[ends] - points[starts], minlength=n).astype(np.int64)
    repeated = np.zeros(n, dtype=np.int64)
    if len(starts) >= 3:
        h = tb.span_hashes(tb.prefix_hashes(data), starts, ends)
        same = np.flatnonzero(rows[:-2] == rows[2:])
        f = tb.mix64(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)
        grams = tb.mix64(h[same] * f[0] + h[same + 1] * f[1] + h[same + 2] * f[2] + rows[same].astype(np.uint64) * f[3])
        order = np.argsort(grams)
        ordered = grams[order]
        twice = np.zeros(len(grams), dtype=bool)
        equal = ordered[1:] == ordered[:-1]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        covered = np.zeros(len(starts), dtype=bool)
        for k in range(3):
            covered[same[twice] + k] = True
        repeated = np.bincount(rows[covered], minlength=n)
    return words, chars, repeated


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_lost_lines long, lost_share double, lost_punctuation long, lost_navigation long, lost_boilerplate long"
)


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row of counts and verdict for every document; with ``with_text`` also its cleaned text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            data, at = tb.string_buffers(batch.column("text"))
            for low, high in tb.row_chunks(at, 4_000_000):
                part, local = data[at[low] : at[high]], at[low : high + 1] - at[low]
                words, chars, repeated = _counts(part, local)
                raw = part.tobytes()
                out = []
                for k in range(high - low):
                    text = raw[local[k] : local[k + 1]]
                    n = int(words[k])
                    dup, lost, whole, n_lines, n_lost, by = _document(text, limits)
                    failed = n < limits.min_words or 100 * int(repeated[k]) > limits.most_repeat_percent * n
                    share = lost / whole if whole else 0.0
                    symbols = len(_SYMBOLS.findall(text))
                    row = (n, int(chars[k]), symbols, dup, int(repeated[k]), failed, not failed and share <= limits.most_lost and lost - by.get("boilerplate", 0) <= limits.most_junk * whole, n_lines, n_lost, share, by.get("punctuation", 0), by.get("navigation", 0), by.get("boilerplate", 0))
                    out.append((*row, cleaned(text.decode("utf-8", "replace"), limits)) if with_text else row)
                columns = [pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), *columns], ["id", *[f.name for f in fields]])

    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    schema = SCHEMA + (", cleaned string" if with_text else "")
    fields = [pa.field(name, types[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
