"""Detectors and masks of sensitive values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of values that are masked, in the order in which they are tried.
CARD = r"(?U)(?<![0-9A-Za-z./_-])(?:\d[\s\-]?){12,18}\d(?![0-9A-Za-z./_-])"
CARD_CODE = r"(?iU)(\b(?:cvv2?|cvc2?|cid|csc)\b\s*[:=]?\s*\"?)\d{3,4}\"?"
TRACK = r"(?U)%B\d{12,19}\^[^?]{2,90}\?"
SSN = r"(?U)(?<!\d)\d{3}[-.\t \u00a0\u2009\u202f\u2007]\d{2}[-.\t \u00a0\u2009\u202f\u2007]\d{4}(?!\d)"
SSN_NAMED = r"(?iU)\b(?:ssn|social[\s_-]*sec(?:urity)?(?:[\s_-]*(?:no|num|number))?|itin|tin|taxpayer[\s_-]*id)\b['\"]?\s*[:=#-]?\s*['\"]?(?<!\d)\d{9}(?!\d)"
AWS_KEY = r"(?U)\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[0-9A-Z]{16}\b"
GITHUB_TOKEN = r"(?U)\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22}_[A-Za-z0-9]{59})\b"
SLACK_TOKEN = r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,72}\b"
STRIPE_KEY = r"(?U)\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,99}\b"
GOOGLE_API_KEY = r"(?U)\bAIza[0-9A-Za-z_-]{35}\b"
AZURE_SAS = r"(?iU)\bsig=[0-9A-Za-z%+/=]{20,}\b"
TWILIO_KEY = r"(?U)\bSK[0-9a-fA-F]{32}\b"
JWT = r"(?U)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
BEARER = r"(?iU)\b(?:Bearer|Basic)\s+([A-Za-z0-9+/=._-]{8,})\b"
URL_CREDENTIALS = r"(?iU)\b([a-z][a-z0-9+.\-]*://[^\s:/@]+:)[^\s/@]{1,256}@"
PRIVATE_KEY = r"-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}[\s\S]*?-{5}END [A-Z ]*PRIVATE KEY-{5}"
SECRET = (
    r"(?iU)(?=[acpst])(?:\b|(?<=[a-z]))(pass(?:word|wd)?|pwd|secret|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?token|token|credential)s?\b"
    r"['\"`]?\s*[:=]\s*(?<q>['\"`]?)([^\s'\"`,;\x00]{6,256})\k<q>"
)
# What stands for a secret without being one, names that always hold one, and values that are code.
NO_SECRET = r"(?i)^(?:\$\{?[A-Z0-9_.]+\}?|%[A-Z0-9_]+%|<[^>]+>|\*{3,}|x{3,}|\[?redacted\]?|\[redacted-[a-z0-9-]+\]|null|none|true|false|changeme|your[_-]?\w+|placeholder|example)\z"
STRONG_NAMES = ("password", "passwd", "pwd", "apikey", "accesskey", "clientsecret", "authtoken")
CODE = r"(?U)^(?:\(|[A-Za-z_]\w*\(|[A-Za-z_]\w*\.\w)"
MAESTRO = (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763)


def _then(state: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a state that is computed once, however often ``step`` uses it; the optimizer can't copy it into each use."""
    return F.transform(F.array(state), step)[0]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    return F.call_function("luhn_check", digits)


def card_network(digits: Column) -> Column:
    """Whether length and leading digits belong to a card network."""
    n = F.length(digits)
    two, three, four = (F.substring(digits, 1, k).cast("int") for k in (2, 3, 4))
    amex = (n == 15) & two.isin(34, 37)
    visa = digits.startswith("4") & n.between(13, 19)
    mastercard = (n == 16) & (two.between(51, 55) | four.between(2221, 2720))
    discover_jcb_unionpay = n.between(16, 19) & ((four == 6011) | (two == 65) | three.between(644, 649) | four.between(3528, 3589) | (two == 62))
    diners = n.between(14, 19) & (two == 36)
    maestro = n.between(12, 19) & four.isin(*MAESTRO)
    rupay = (n == 16) & ((three == 508) | two.isin(81, 82))
    return amex | visa | mastercard | discover_jcb_unionpay | diners | maestro | rupay


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _card(x: Column, sign: Column) -> Column:
    return _then(_digits(x), lambda d: F.when(card_network(d) & luhn(d), sign))


def ssn_valid(digits: Column) -> Column:
    """Whether nine digits can be a number: no part is zero and the area is not 666; areas from 900 on can."""
    area, group, serial = (F.substring(digits, at, n).cast("int") for at, n in ((1, 3), (4, 2), (6, 4)))
    return ~area.isin(0, 666) & (group != 0) & (serial != 0)


def _ssn(x: Column, sign: Column) -> Column:
    return _then(_digits(x), lambda d: F.when(ssn_valid(d), sign))


def _named_ssn(x: Column, sign: Column) -> Column:
    return F.when(ssn_valid(F.right(x, F.lit(9))), F.concat(F.substr(x, F.lit(1), F.length(x) - 9), sign))


def _bearer(x: Column, sign: Column) -> Column:
    """A value of letters only is prose."""
    return F.when(F.regexp_extract(x, BEARER, 1).rlike(r"(?U)[^\p{IsAlphabetic}]"), sign)


def _secret(x: Column, sign: Column) -> Column:
    """Values stay that stand for one, and, after a name that is not strong and without quotes, prose and code."""

    def parts(m: Column) -> Column:
        bare = F.regexp_replace(m["value"], r"[).}\]!?>]+$", "")
        core = F.when((m["quote"] != "") | (F.length(bare) < 6), m["value"]).otherwise(bare)
        return F.struct(m["name"].alias("name"), m["quote"].alias("quote"), m["value"].alias("value"), core.alias("core"))

    def mask(m: Column) -> Column:
        quote, value, core = m["quote"], m["value"], m["core"]
        weak = (quote == "") & ~F.regexp_replace(F.lower(m["name"]), "[^a-z]", "").isin(*STRONG_NAMES)
        word = core.rlike(r"^\p{L}+\z") & (F.lower(core) == core) & (F.length(core) < 20)
        head = F.substr(x, F.lit(1), F.length(x) - F.length(value) - F.length(quote))
        tail = F.concat(F.substr(value, F.length(core) + 1), quote)
        return F.when(~value.rlike(NO_SECRET) & ~(weak & (word | core.rlike(CODE))), F.concat(head, sign, tail))

    groups = F.struct(*[F.regexp_extract(x, SECRET, i).alias(k) for i, k in enumerate(("name", "quote", "value"), 1)])
    return _then(_then(groups, parts), mask)


@dataclass(frozen=True)
class Detector:
    """A pattern, and what a match turns into: a template around the sign, or a function of match and sign (null: it stays).

    Every text with a match holds the string ``holds`` and has the pattern ``needs``; others skip the detector.  Such a
    pattern begins with one character or class, so that most places of a text are passed by at once.
    """

    label: str
    pattern: str
    becomes: str | Callable[[Column, Column], Column] = "{}"
    holds: str = ""
    needs: str = ""


DETECTORS = [
    Detector("PAN", CARD, _card, needs=r"(?U)\d[\s\-]?\d[\s\-]?(?:\d[\s\-]?){10}\d"),
    Detector("CVV", CARD_CODE, "$1{}", needs=r"(?iU)[cdv2]\s*[:=]?\s*\"?\d{3}"),
    Detector("TRACK", TRACK, holds="%B"),
    Detector("SSN", SSN, _ssn, needs=r"\p{Nd}\p{Nd}[^\p{Nd}]\p{Nd}{4}"),
    Detector("SSN", SSN_NAMED, _named_ssn, needs=r"\p{Nd}\p{Nd}{8}"),
    Detector("AWS-KEY", AWS_KEY, needs="A[KSGIRN][IPDOV]A"),
    Detector("GITHUB-TOKEN", GITHUB_TOKEN, holds="_", needs="g(?:h[pousr]_|ithub_pat_)"),
    Detector("SLACK-TOKEN", SLACK_TOKEN, holds="xox"),
    Detector("STRIPE-KEY", STRIPE_KEY, holds="k_"),
    Detector("GOOGLE-API-KEY", GOOGLE_API_KEY, holds="AIza"),
    Detector("AZURE-SAS", AZURE_SAS, holds="=", needs="(?iu)g=[0-9A-Za-z%+/=]{20}"),
    Detector("TWILIO-KEY", TWILIO_KEY, holds="SK"),
    Detector("JWT", JWT, holds="eyJ"),
    Detector("BEARER", BEARER, _bearer, needs=r"(?iU)[cr]\s+[A-Za-z0-9+/=._-]{8}"),
    Detector("URL-CRED", URL_CREDENTIALS, "$1{}@", holds="://"),
    Detector("PRIVATE-KEY", PRIVATE_KEY, holds="PRIVATE KEY-"),
    Detector("SECRET", SECRET, _secret, needs=r"(?iU)[dlnsty]['\"`]?\s*[:=]"),
]
LABELS = list(dict.fromkeys(d.label for d in DETECTORS))


# what stands for a match while its text is put together: two signs that meet have a digit there
_MARK = "\0\0|"


def _try(state: Column, i: int) -> Column:
    """The state (text, hits) after a detector: it stays unless the text has what the detector needs and something is masked."""
    detector = DETECTORS[i]
    pattern, sign = F.lit(detector.pattern), f"\0{LABELS.index(detector.label)}\0"

    def after(s: Column, n: Column, text: Column) -> Column:
        return F.when(n > 0, F.struct(text.alias("text"), F.array_append(s["hits"], F.struct(F.lit(i).alias("i"), n.alias("n"))).alias("hits"))).otherwise(s)

    def replaced(s: Column) -> Column:
        return _then(F.regexp_count(s["text"], pattern), lambda n: after(s, n, F.regexp_replace(s["text"], pattern, F.lit(detector.becomes.format(sign)))))

    def turned(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s["text"], pattern, F.lit(0)), lambda x: F.struct(x.alias("was"), detector.becomes(x, F.lit(sign)).alias("now")))
        return _then(found, lambda found: after(s, F.size(F.filter(found, lambda m: m["now"].isNotNull())), put(s, found)))

    def put(s: Column, found: Column) -> Column:
        # cut at a mark, as cutting at the pattern would compile it again for each text
        around = F.split(F.regexp_replace(s["text"], pattern, F.lit(_MARK)), r"\x00\x00\|", -1)
        return F.array_join(F.zip_with(around, found, lambda a, m: F.concat(a, F.coalesce(m["now"], m["was"], F.lit("")))), "")

    step = replaced if isinstance(detector.becomes, str) else turned

    def has(text: Column) -> Column:
        tests = [F.contains(text, F.lit(detector.holds))] * (detector.holds != "") + [text.rlike(detector.needs)] * (detector.needs != "")
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    return _then(state, lambda s: F.when(has(s["text"]), step(s)).otherwise(s))


def redact(rows: DataFrame, text: str = "text") -> DataFrame:
    """``redacted`` (the text with sensitive values masked) and ``counts`` (how many each of DETECTORS found) beside ``rows``.

    A detector leaves a sign between NUL characters, which no later one looks into; signs become ``[REDACTED-label]``
    at the end, and NULs of the text itself go first.  A null text gives null; masking twice changes nothing.
    """
    state = F.struct(F.replace(text, F.lit("\0"), F.lit("")).alias("text"), F.array().cast("array<struct<i:int,n:int>>").alias("hits"))
    out = rows.withColumn("_state", state)
    for i in range(len(DETECTORS)):
        out = out.withColumn("_state", _try(F.col("_state"), i))

    def plain(text: Column) -> Column:
        told = text
        for k, label in enumerate(LABELS):
            told = F.replace(told, F.lit(f"\0{k}\0"), F.lit(f"[REDACTED-{label}]"))
        return F.when(F.contains(text, F.lit("\0")), told).otherwise(text)

    def counts(hits: Column) -> Column:
        of = lambda i: F.get(F.filter(hits, lambda h: h["i"] == i), F.lit(0))["n"]
        return F.array(*[F.coalesce(of(i), F.lit(0)) for i in range(len(DETECTORS))])

    return out.select(*rows.columns, _then(F.col("_state.text"), plain).alias("redacted"), _then(F.col("_state.hits"), counts).alias("counts"))


def hits(counts: Column) -> Column:
    """(label, n) of each detector that masked something."""
    labelled = F.zip_with(F.array(*[F.lit(d.label) for d in DETECTORS]), counts, lambda k, n: F.struct(k.alias("label"), n.alias("n")))
    return F.filter(labelled, lambda h: h["n"] > 0)
