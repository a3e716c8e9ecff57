"""PII (operator 5): detected entities get keyed surrogates of the same type, gender, script and format.

Every surrogate is a keyed bijection of the original, so distinct originals stay distinct, and the same original has the
same surrogate wherever it stands (coreference), without a table of entities:

* a value's characters are digits of a mixed-radix number (digits, lower and upper case letters, hexadecimal digits, and
  letters of other scripts each stay in their own alphabet; the rest stays as it is), and that number goes to the one after it
  in an order that a Feistel network with cycle walking makes of the key: one cycle through all values, so none stays as it is;
* card numbers that pass the Luhn test keep their first digit and pass it again; addresses of hosts stay valid, private
  ones in their network; an e-mail's local part and each label of its domain are mapped apart, so that one domain
  stays one domain;
* a known first or last name is permuted within its list (first names by gender), any other name letter by letter,
  walking on while the result is a known name. A title keeps its place, and "Mr Smith" after "John Smith" agrees with it.

Names are found after titles and "name" phrases, and as pairs of a known first and last name. A second pass over a text in which
names were found replaces every other whole-word mention of them in it: the full name, its last and its first name.

``checked`` tests the two properties on the output all the same, in a job of its own before anything is returned: the query and
the pipeline's stage fail if a surrogate stands for two originals, or an original has two.

The key is the caller's. The query and the stage take the setting ``spark.wardlens.pii.key``; where it is unset, a random key is
drawn for the session, so nobody can turn the surrogates back, and another session's surrogates differ.

Edge cases: null text stays null; texts without entities, empty ones included, are returned as they are; repeated rows get
equal results, ties included; a very long text is a slice of its own and replaced whole; an empty table gives no rows; columns besides ``doc_id`` and ``text`` pass through ``replace_pii`` whatever
their names, and ``n_chars``, where there is one, is set to the new text's length if the text changed.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_slices, table, tidied

MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Edward Hans Peter Klaus Jürgen Wolfgang Stefan Pierre Jean Michel André Philippe Luc José Juan Carlos Luis Miguel Javier Pedro Sergio".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Anna Ursula Monika Petra Sabine Claudia Marie Nathalie Isabelle Sylvie Catherine Martine María Carmen Ana Isabel Laura Cristina Lucía Elena".split()
LAST = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Bernard Dubois Robert Richard Petit Durand Leroy Moreau García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Díaz".split()
HE, SHE = "Mr|Herr|Monsieur|Señor|Sr|Don|Sir", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña"

_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][a-zà-öø-ÿα-ωа-я]+(?:[-'’][A-ZÀ-ÖØ-ÞΑ-ΩА-Я][a-zà-öø-ÿα-ωа-я]+)?"
#: In this order: an earlier kind wins where two begin at one place.
PATTERNS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"),
    ("userinfo", r"(?<=://)[^\s/:@]+:[^\s/@]+(?=@)"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret_value>[^\s\"',;]{6,})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    ("mac", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("number", r"(?<![\w.,-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.,-])\d{9,19}(?!\w)"),
    ("name", rf"(?:\b(?P<he>{HE})\b|\b(?P<she>{SHE})\b|\b(?:Dr|Prof|[Mm]y name is|[Nn]ame:))\.? (?P<name_value>{_NAME}(?: {_NAME})?)"),
]
#: A known first and last name need no title.
PATTERNS.append(("pair", rf"\b(?=[A-Z])(?P<pair_value>(?:{'|'.join(MALE + FEMALE)}) (?:{'|'.join(LAST)})(?:[-'’][A-ZÀ-ÖØ-ÞΑ-ΩА-Я][a-zà-öø-ÿα-ωа-я]+)?)(?!\w)"))
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_MAYBE = rf"[0-9]|@|://|(?i:password|passwd|pwd|secret|token|key)|\b(?:{HE}|{SHE}|Dr|Prof|[Mm]y name is|[Nn]ame:)\b"
_MAYBE += rf"|(?:{'|'.join(MALE + FEMALE)}) (?:{'|'.join(LAST)})"
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"]
_ALPHABETS += ["".join(map(chr, range(a, b + 1))) for a, b in ((0x3B1, 0x3C1), (0x391, 0x3A1), (0x430, 0x44F), (0x410, 0x42F), (0x5D0, 0x5EA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))]
_OF = {c: a for a in _ALPHABETS for c in a}


_HEX = "0123456789abcdef"


def _is_hex(value: str) -> bool:
    return len(value) >= 8 and not set(value) - set(_HEX) and bool(set(value) & set(_HEX[:10])) and bool(set(value) & set(_HEX[10:]))


class Surrogates:
    """The keyed bijections."""

    def __init__(self, key: bytes):
        self.key = key
        self.lists = {}
        for what, names in (("male", MALE), ("female", FEMALE), ("last", LAST)):
            order = sorted(names, key=lambda n: hashlib.blake2b(f"{what} {n}".encode(), key=key[:64]).digest())
            self.lists[what] = dict(zip(order, order[1:] + order[:1]))  # one cycle: nobody keeps a name

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A keyed bijection of 0 ... n - 1 of one cycle: the value whose place in a keyed order is the next one."""
        return self._place((self._place(x, n, tweak, False) + 1) % n, n, tweak, True) if n > 1 else x

    def _place(self, x: int, n: int, tweak: str, back: bool) -> int:
        """A Feistel network of 8 rounds, or its inverse, walked until it falls below n."""
        half = ((n - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        size = (half + 7) // 8 + 8
        while True:
            left, right = x >> half, x & mask
            for r in range(7, -1, -1) if back else range(8):
                if back:
                    left, right = right, left
                h = hashlib.blake2b(b"%d|%s|%d" % (r, tweak.encode(), right), digest_size=min(64, size), key=self.key[:64]).digest()
                left ^= int.from_bytes(h * (1 + size // 64), "big") & mask
                if not back:
                    left, right = right, left
            x = left << half | right
            if x < n:
                return x

    def shaped(self, value: str, tweak: str) -> str:
        """Characters stay within their alphabets; hexadecimal values stay hexadecimal, and no other becomes one."""
        hexa = _is_hex(value)
        sets = [_HEX if hexa else _OF.get(c) for c in value]
        n = 1
        for a in sets:
            n *= len(a) if a else 1
        while True:
            x = 0
            for c, a in zip(value, sets):
                if a:
                    x = x * len(a) + a.index(c)
            x = self.permute(x, n, f"{tweak} {len(value)} {hexa}")
            out = list(value)
            for i in range(len(value) - 1, -1, -1):
                if sets[i]:
                    x, k = divmod(x, len(sets[i]))
                    out[i] = sets[i][k]
            value = "".join(out)
            if _is_hex(value) == hexa:
                return value

    def digits(self, value: str, tweak: str, keep: int = 0) -> str:
        """Permutes the digits after the first ``keep``; the layout stays."""
        d = [c for c in value if c.isdigit()]
        new = "".join(d[:keep]) + self.shaped("".join(d[keep:]), tweak)
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in value)

    def number(self, value: str) -> str:
        d = "".join(c for c in value if c.isdigit())
        if len(d) < 13 or not luhn(d):
            # A number that fails the test may not come to pass it: then one of the others would have to fail.
            x = d
            while True:
                x = self.shaped(x, "number")
                if len(d) < 13 or not luhn(x):
                    break
            d = x
        else:
            body = d[0] + self.shaped(d[1:-1], "card " + d[0])
            d = body + next(c for c in "0123456789" if luhn(body + c))
        it = iter(d)
        return "".join(next(it) if c.isdigit() else c for c in value)

    def ip(self, value: str) -> str:
        a = [int(x) for x in value.split(".")]
        x = a[0] << 24 | a[1] << 16 | a[2] << 8 | a[3]
        for net, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)):
            if x >> bits == net >> bits:
                x = net | self.permute(x & ((1 << bits) - 1), 1 << bits, f"ip {net}")
                break
        else:
            public = lambda y: 1 <= y >> 24 <= 223 and all(y >> b != n >> b for n, b in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)))
            inside = public(x)
            while True:
                x = self.permute(x, 1 << 32, "ip")
                if public(x) or not inside:
                    break
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        *labels, last = domain.split(".")
        return self.shaped(local, "local") + "@" + ".".join([self.shaped(x, "label") for x in labels] + [last])

    def name(self, value: str, gender: str) -> str:
        words = value.split(" ")
        out = []
        for i, w in enumerate(words):
            first = len(words) > 1 and i == 0
            order = ([gender] if gender else ["male", "female"]) + ["male", "female"] if first else ["last"]
            for what in order:
                if w in self.lists[what]:
                    out.append(self.lists[what][w])
                    break
            else:
                while True:
                    w = self.shaped(w, "first" if first else "last")
                    if not any(w in self.lists[what] for what in order):
                        break
                out.append(w)
        return " ".join(out)

    def of(self, kind: str, m: re.Match) -> tuple[int, int, str]:
        if kind == "email":
            return *m.span(), self.email(m.group())
        if kind == "secret":
            return *m.span("secret_value"), self.shaped(m.group("secret_value"), "secret")
        if kind == "name":
            gender = "male" if m.group("he") else "female" if m.group("she") else ""
            return *m.span("name_value"), self.name(m.group("name_value"), gender)
        if kind == "pair":
            return *m.span("pair_value"), self.name(m.group("pair_value"), "")
        if kind == "ip":
            return *m.span(), self.ip(m.group())
        if kind == "number":
            return *m.span(), self.number(m.group())
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=[ .(-])", m.group())
            return *m.span(), self.digits(m.group(), "phone" + (code.group() if code else ""), len(code.group()) - 1 if code else 0)
        if kind == "aws_key":
            return *m.span(), m.group()[:4] + self.shaped(m.group()[4:], "aws")
        return *m.span(), self.shaped(m.group(), kind)

    def mentions(self, text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """Mentions outside ``spans`` of the names among them, whole words only: one pass over the text's capitalised words."""
        whole, last, first = {}, {}, {}
        for kind, a, b, new in spans:
            if kind == "name":
                old, new = text[a:b].split(" "), new.split(" ")
                whole[" ".join(old)] = ("name", " ".join(new))
                last[old[-1]] = ("name", new[-1])
                if len(old) > 1:
                    first[old[0]] = ("first_name", new[0])
        if not whole:
            return []
        known = first | last | whole  # where one word is several of them: the whole name, then the last name
        taken = iter([(a, b) for _, a, b, _ in spans])
        a, b = next(taken)
        free = []
        for m in _WORD.finditer(text):
            while b <= m.start():
                a, b = next(taken, (len(text), len(text) + 1))
            if m.end() <= a:
                free.append(m.span())
        out, at = [], 0
        for i, (a, b) in enumerate(free):
            if a < at:
                continue
            ends = [b] if i + 1 == len(free) or free[i + 1][0] != b + 1 or text[b] != " " else [free[i + 1][1], b]
            for end in ends:
                if text[a:end] in known:
                    kind, new = known[text[a:end]]
                    out.append((kind, a, end, new))
                    at = end
                    break
        return out

    def replace(self, text: str) -> tuple[str, list[dict]]:
        spans = []
        for m in FINDER.finditer(text):
            kind = next(k for k, _ in PATTERNS if m.group(k) is not None)
            spans.append(("name" if kind == "pair" else kind, *self.of(kind, m)))
        spans = sorted(spans + self.mentions(text, spans), key=lambda s: s[1])
        out, found, at = [], [], 0
        for kind, a, b, new in spans:
            out += [text[at:a], new]
            found.append({"kind": kind, "start": a, "end": b, "surrogate": new, "digest": hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=8, key=self.key[:64]).hexdigest()})
            at = b
        return ("".join(out) + text[at:], found) if found else (text, [])


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        k = int(c) * (1 + i % 2)
        t += k - 9 * (k > 9)
    return t % 10 == 0


ENTITIES = "entities array<struct<kind:string,start:int,end:int,surrogate:string,digest:string>>"


def session_key(spark: SparkSession) -> bytes:
    """The setting's key, or a random one that lasts as long as the session."""
    key = spark.conf.get("spark.wardlens.pii.key", None)
    if key is not None:
        return key.encode()
    if not hasattr(spark, "_wardlens_key"):
        spark._wardlens_key = secrets.token_bytes(32)
    return spark._wardlens_key


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows with surrogates in ``text`` and a column ``entities``: kind, span in the original, surrogate, keyed digest."""
    names = docs.columns
    at = names.index(text)
    size = names.index("n_chars") if "n_chars" in names else -1
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = StructType([*inner.schema.fields, *StructType.fromDDL(ENTITIES).fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("digest", pa.string())]))

    def run(batches):
        made = Surrogates(key)
        for whole in batches:
            for a, b in byte_slices(whole.column(at), 16_000_000):
                part = whole.slice(a, b - a)
                cols = list(part.columns)
                maybe = pc.fill_null(pc.match_substring_regex(cols[at], _MAYBE), False).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
                entities: list = [[] for _ in range(part.num_rows)]
                if maybe:
                    changed = {}
                    for i in maybe:
                        new, entities[i] = made.replace(cols[at][i].as_py())
                        if entities[i]:
                            changed[i] = new
                    mask = [i in changed for i in range(part.num_rows)]
                    cols[at] = pc.replace_with_mask(cols[at], pa.array(mask), pa.array([changed[i] for i in sorted(changed)], cols[at].type))
                    if size >= 0:
                        cols[size] = pc.if_else(pa.array(mask), pc.utf8_length(cols[at]).cast(cols[size].type), cols[size])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(entities, kind)], [*[f"c{i}" for i in range(len(names))], "entities"])

    return inner.mapInArrow(tidied(run), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "entities")


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for two originals, and originals with two surrogates, by kind. No rows: all is well.

    Originals are told apart by their keyed digests; equal ones are combined before the shuffle."""
    e = replaced.select(F.explode("entities").alias("e")).select("e.kind", "e.surrogate", "e.digest").distinct()
    two = e.groupBy("kind", F.col("surrogate").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return two.unionByName(e.groupBy("kind", F.col("digest").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def checked(replaced: DataFrame) -> DataFrame:
    """``replaced`` as it is, once no collision was found in it. Texts are read a second time; nothing but the distinct pairs of
    surrogate and keyed digest is shuffled."""
    bad = collisions(replaced).limit(5).collect()
    if bad:
        raise RuntimeError(f"surrogates collide: {[(r.kind, r.n) for r in bad]}")
    return replaced


def stage(docs: DataFrame) -> DataFrame:
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", "n_chars") else f"d{i}") for i, c in enumerate(names)])
    out = checked(replace_pii(inner, session_key(docs.sparkSession)))
    return out.select(*[F.col(c if c in ("text", "n_chars") else f"d{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked(replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))
