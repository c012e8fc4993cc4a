"""Personal data: candidates from wide generators, judged by gradient-boosted trees.

Base spans (emails, IPv4 addresses, card numbers, phone numbers) come from strict patterns and always
stand.  Wide generators propose further, overlapping spans: obfuscated emails and addresses, IPv6, card
and phone numbers in other layouts, values that are assigned to a key or password, and random-looking strings.  Boosted trees score each candidate from its format and its context;
a threshold per kind, calibrated on held-back rows for ``precision``, selects redactions, and of
overlapping ones the best scored stays.

The trees are trained on generated, labelled sentences (:func:`training_rows`; a bounded count), so no
text of the corpus is labelled by its own patterns.  One pass over the texts finds base spans and
candidates; only ids and spans are shuffled, to bring a document's judged candidates together.

Defined cases: null and empty texts have no spans; offsets count code points, ends are exclusive;
repeated rows, and rows sharing an id, are judged each for itself; overlapping candidates of equal score
yield to the longer, then the earlier; an empty table gives an empty result; only doc_id and text are
read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that strict patterns find; the others come from generators alone.
BASE = KINDS[:4]
PRECISION = 0.98
TRAINING_ROWS = 4000

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first digit of a run, so the look-behind changes no match and keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            free = tail.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# Wide generators.  All repeats are bounded, so time stays linear in the text.
_WIDE_EMAIL = re.compile(r"[\w.+-]{1,64}[ ]?(?:@|\(at\)|\[at\]|\{at\})[ ]?[\w-]{1,63}(?:[ ]?(?:\.|\(dot\)|\[dot\]|\{dot\})[ ]?[\w-]{1,63}){1,4}", re.I)
_WIDE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:[ ]?(?:\.|\[\.\]|\(\.\)|\[dot\])[ ]?[0-9]{1,3}){3}(?![\w])|(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])", re.I)
_WIDE_CARD = re.compile(r"(?<![\w+])[0-9]{3,6}(?:[ ./_-]{0,2}[0-9]{2,6}){2,5}(?![\w])")
_WIDE_PHONE = re.compile(r"(?<![\w+])(?:00|\()?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w])")
_ASSIGNED = re.compile(r"""(?<![^\W_])(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|(?:access|private|auth|secret)[_ -]?key|auth|bearer|credentials?)['"]?[ ]{0,3}(?:[:=]|=>|[ ]is[ ])[ ]{0,3}['"]?([^\s'"<>]{5,127}[^\s'"<>.,;:!?)])""", re.I)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,63}[0-9])[A-Za-z0-9+/_-]{20,128}(?![A-Za-z0-9+/_-])")
_CUES = tuple(
    re.compile(p, re.I)
    for p in (
        r"mail|contact|write|reach",
        r"\bip\b|host|server|address|addr|ping|login",
        r"card|visa|master|amex|credit|debit|payment|paid",
        r"phone|call|tel|mobile|fax|cell|text me|ring",
        r"version|\bv\.?$|release|build|section|chapter|figure",
        r"order|invoice|ref|ticket|serial|isbn|part|item|id\b|no\.",
        r"date|year|time|score|total|amount|price|usd|eur|\$",
        r"token|secret|passw|pwd|key|auth|bearer|credential",
        r"commit|sha|md5|checksum|hash|etag|digest|revision|uuid|build",
    )
)
FORMATS = (
    "k0", "k1", "k2", "k3", "k4", "length", "digits", "groups", "longest", "shortest", "separators", "kinds_of_separator", "luhn", "octets",
    "at_sign", "worded", "paren", "zeros", "hex", "dotted", "dashed", "spaced", "slashed", "before_word", "after_word", "line_start",
    "context_digits", "tld", "entropy", "letters", "uppers", "is_hex", "assigned", "quoted", "changes",
)
FEATURES = (*FORMATS, *[f"cue{k}" for k in range(len(_CUES))])


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """FEATURES of a candidate: its format, and the 40 characters before and 20 after it."""
    s, left, right = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    seps = [c for c in s if not c.isalnum()]
    out = [float(kind == k) for k in range(len(KINDS))]
    out += [len(s), len(digits), len(groups), max(sizes), min(sizes), len(seps), len(set(seps))]
    out += [13 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)]
    out += ["@" in s, bool(re.search(r"[(\[{](?:at|dot|\.)", s, re.I)), "(" in s, s.startswith("0"), ":" in s]
    out += [s.count("."), s.count("-"), s.count(" "), s.count("/"), left[-1:].isalnum(), right[:1].isalnum(), start == 0 or left[-1:] == "\n"]
    out += [len(re.findall("[0-9]", left + right)), bool(re.search(r"[a-z]{2,6}\Z", s, re.I))]
    letters, each = [c for c in s if c.isalpha()], Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in each.values())
    classes = [c.isdigit() * 2 + c.isupper() for c in s if c.isalnum()]
    out += [entropy, len(letters), sum(c.isupper() for c in letters), bool(re.fullmatch("[0-9A-Fa-f-]+", s))]
    out += [bool(re.search(r"(?:[:=]|\bis)[ ]{0,3}['\"]?\Z", left)), left[-1:] in "'\"" and left != "", sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / len(s)]
    out += [bool(c.search(left)) for c in _CUES]
    return [float(x) for x in out]


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of every generator that overlap no base span; they may overlap each other."""
    found: list[tuple[int, int, int]] = []
    low = "(at)" in text or "[at]" in text or "{at}" in text or "@" in text or "(AT)" in text or "[AT]" in text
    if low:
        found += [(0, *m.span()) for m in _WIDE_EMAIL.finditer(text)]
    if "=" in text or ":" in text or " is " in text:
        found += [(4, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        found += [(4, *m.span()) for m in _RANDOM.finditer(text)]
        for kind, pattern in ((1, _WIDE_IP), (2, _WIDE_CARD), (3, _WIDE_PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b))
        return k == 0 or ends[k - 1] <= a

    keep = {2: (13, 19), 3: (7, 15)}
    out = []
    for kind, a, b in dict.fromkeys(found):
        low, high = keep.get(kind, (0, 128))
        if free(a, b) and low <= len(_digits(text[a:b])) <= high:
            out.append((kind, a, b))
    return out


def _label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(text: pd.Series) -> pd.DataFrame:
    counts, digests, base, wide = [], [], [], []
    for t in text.fillna(""):
        b = base_spans(t)
        w = wide_spans(t, b)
        kinds = [k for k, _, _ in b]
        counts.append([kinds.count(k) for k in range(len(BASE))])
        base.append(_label(b))
        digests.append(hashlib.sha256(base[-1].encode()).hexdigest())
        wide.append([{"kind": k, "start": a, "stop": e, "features": described(t, k, a, e)} for k, a, e in w])
    out = pd.DataFrame(counts, columns=[f"n_{k}" for k in BASE], dtype="int64")
    return out.assign(base_sha256=digests, base=base, wide=pd.Series(wide, dtype=object))


FOUND = f"{', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, base string, wide array<struct<kind:int,start:int,stop:int,features:array<double>>>"


def training_rows(n: int = TRAINING_ROWS, seed: int = 11) -> list[tuple[str, int]]:
    """Sentences with one marked form each and its label, 1 for personal data and 0 for a look-alike."""
    rng = np.random.default_rng(seed)
    name = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 9)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    octet = lambda: str(rng.integers(0, 256))
    pick = lambda *x: x[rng.integers(len(x))]

    def card(valid: bool) -> str:
        body = num(15)
        d = next(c for c in "0123456789" if luhn(body + c) == valid)
        # strict patterns already take valid numbers with single spaces, dashes or nothing between groups
        body, sep = body + d, pick(".", "/", "_", "  ") if valid else pick("", "", " ", "-", ".", "/")
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    mixed = lambda k: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), k))

    def kept_secret() -> tuple[str, str]:
        lead = pick("token", "secret", "password", "pwd", "api_key", "api-key", "access_key", "auth", "bearer", "secret_key")
        value = pick(hexed(pick(32, 40, 40, 64)), mixed(rng.integers(16, 48)), f"{name()}{num(3)}{pick('!', '#', '')}{mixed(3)}")
        return f"{lead}{pick(' = ', '=', ': ', ' : ')}", pick("", "", '"', "'") + value

    good = (
        kept_secret,
        kept_secret,
        lambda: (pick("mail me at ", "contact: ", "write to ", "", "e-mail "), f"{name()}{pick('', '.')}{name()}{pick(' (at) ', '(at)', ' [at] ', ' @ ')}{name()}{pick(' (dot) ', '[dot]', '.', ' . ')}{pick('com', 'org', 'net', 'de')}"),
        lambda: (pick("server ", "host ", "login from ", "ip ", "ping "), pick("[.]", "(.)", " . ", "[dot]").join(octet() for _ in range(4))),
        lambda: (pick("host ", "address ", "", "ip "), ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8))),
        lambda: (pick("card ", "credit card: ", "visa ", "paid with ", "payment by card "), card(True)),
        lambda: (pick("call ", "phone: ", "tel ", "mobile ", "my cell is ", "fax "), pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(4)}", f"0{num(3)}/{num(6)[:5]} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}")),
    )
    bad = (
        lambda: (pick("commit ", "sha1 ", "checksum: ", "md5 = ", "etag: ", "revision ", "digest="), hexed(pick(32, 40, 64))),
        lambda: (pick("token ", "the secret ", "password: ", "auth ", "key = "), pick("required", "unknown", "changed", "missing", "forgotten")),
        lambda: (pick("see ", "page ", ""), "-".join(name() for _ in range(rng.integers(3, 6))) + f"-{num(2)}"),
        lambda: (pick("uuid ", "id ", "build "), "-".join(hexed(k) for k in (8, 4, 4, 4, 12))),
        lambda: (pick("version ", "release ", "section ", "build "), ".".join(str(rng.integers(0, 400)) for _ in range(4)) + "5"),
        lambda: (pick("order ", "invoice ", "ref ", "serial ", "ticket ", "", "item "), card(False)),
        lambda: (pick("", "", "card ", "paid ", "call ", "mail "), card(False)),
        lambda: (pick("", "id ", "key "), num(rng.integers(9, 20))),
        lambda: (pick("on ", "date ", "since ", "time "), pick(f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(2)}/{num(2)}/19{num(2)}")),
        lambda: (pick("order ", "isbn ", "part no. ", "id ", "ref "), pick(f"{num(3)}-{num(3)}-{num(4)}", f"978-{num(1)}{num(2)}-{num(5)}-{num(2)}", f"{num(4)} {num(4)}", f"{num(3)} {num(3)} {num(3)}")),
        lambda: (pick("total ", "scores ", "price ", "rows ", ""), " ".join(num(rng.integers(2, 5)) for _ in range(rng.integers(3, 6)))),
        lambda: (pick("see ", "meet ", "vote ", "look "), f"{name()} @ {name()} . {name()}"),
    )
    mark = lambda w: w.capitalize() if rng.random() < 0.1 else w + pick(*[""] * 9, ",", ".", ".\n", "!!", " |")
    filler = lambda: " ".join(mark(name()) for _ in range(rng.integers(0, 15)))
    out = []
    for k in range(n):
        label = int(k % 2 == 0)
        lead, form = pick(*(good if label else bad))()
        line = f"{filler()} {lead}{form} {filler()}."
        out.append((line.upper() if rng.random() < 0.1 else line, label))
    return out


def train(spark: SparkSession, rows: int = TRAINING_ROWS, precision: float = PRECISION) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees, and per kind the lowest threshold with ``precision`` on the third of rows held back."""
    texts = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(training_rows(rows))], "id long, text string, y int")
    cands = texts.select("id", "y", F.explode(F.pandas_udf(_found, FOUND)("text")["wide"]).alias("c"))
    x = cands.select("id", F.col("y").cast("double").alias("label"), F.col("c.kind").alias("kind"), *[F.col("c.features")[k].alias(f) for k, f in enumerate(FEATURES)])
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(x).select("id", "label", "kind", "v").persist()
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(x.filter("id % 3 != 0"))
    held = model.transform(x.filter("id % 3 = 0")).select("kind", "label", vector_to_array("probability")[1].alias("p")).toPandas()
    x.unpersist()
    thresholds = []
    for kind in range(len(KINDS)):
        own = held[held.kind == kind].sort_values(["p", "label"], ascending=[False, True])
        right = own.label.cumsum() / np.arange(1, len(own) + 1)
        fit = own.p[right >= precision]
        thresholds.append(float(max(0.5, fit.min())) if len(fit) else 2.0)
    return model, thresholds


def _selected(base: pd.Series, judged: pd.Series) -> pd.Series:
    out = []
    for b, js in zip(base, judged, strict=True):
        spans = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
        starts: list[int] = []  # of the spans taken so far, which are disjoint, with their ends
        stops: list[int] = []
        for j in sorted(js, key=lambda j: (-j["p"], j["start"] - j["stop"], j["start"], j["kind"])):
            at = bisect.bisect_left(starts, j["start"])
            if (at == 0 or stops[at - 1] <= j["start"]) and (at == len(starts) or starts[at] >= j["stop"]):
                starts.insert(at, j["start"])
                stops.insert(at, j["stop"])
                spans.append((j["kind"], j["start"], j["stop"]))
        out.append(_label(spans))
    return pd.Series(out)


def find_pii(docs: DataFrame, model=None, thresholds: list[float] | None = None) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, spans (all), n_spans (how many)."""
    spark = docs.sparkSession
    bound_batches(spark)
    if model is None:
        model, thresholds = train(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].alias("doc_id"), F.pandas_udf(_found, FOUND)(docs["text"]).alias("f"))
    each = rows.select("rid", "doc_id", *[F.col(f"f.n_{k}").alias(f"n_{k}") for k in BASE], F.col("f.base_sha256").alias("base_sha256"), F.col("f.base").alias("base"), F.explode_outer("f.wide").alias("c"))
    blank = F.array(*[F.lit(0.0)] * len(FEATURES))
    scored = model.transform(each.withColumn("v", array_to_vector(F.coalesce("c.features", blank))))
    p = vector_to_array("probability")[1]
    limit = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("c.kind") + 1)
    taken = F.when(F.col("c").isNotNull() & (p >= limit), F.struct(F.col("c.kind").alias("kind"), F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), p.alias("p")))
    fixed = ("rid", "doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "base")
    gathered = scored.select(*fixed, taken.alias("j")).groupBy(*fixed).agg(F.collect_list("j").alias("js"))
    judged = gathered.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", F.pandas_udf(_selected, "string").asNondeterministic()("base", "js").alias("spans"))
    return judged.withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long"))
