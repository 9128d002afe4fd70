"""Report-text column expressions: rule-cascade labelling and section helpers.

Everything here returns a ``Column`` built from Spark's own string and regex functions, so
labelling stays inside whole-stage codegen (no Python per row).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClassRule:
    """``label`` when some anchor is followed, within the window, by ``include``
    and (if given) by no ``exclude`` match in a window of its own."""

    label: str
    include: str
    exclude: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """Ordered cascade: the first class whose rule holds wins, else ``default``.
    ``subtypes`` is a second, independent cascade (first match wins, else NULL)."""

    name: str
    anchors: str
    window: int
    classes: tuple[ClassRule, ...]
    default: str
    subtypes: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def windowed(anchors: str, window: int, body: str) -> str:
    """``(?i)(anchors)[\\s\\S]{0,N}(body)``: a body match starting at most N characters
    after the end of any anchor match. The window crosses section headers."""
    return f"(?i)({anchors})[\\s\\S]{{0,{window}}}({body})"


_PLAIN = re.compile(r"^[A-Za-z0-9 \-]+$")


def literal_terms(body: str) -> list[str] | None:
    """The alternatives of ``body`` when all are plain text (no regex syntax)."""
    parts = body.split("|")
    return parts if all(_PLAIN.match(p) for p in parts) else None


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(text: Column) -> Column:
    """Fold A–Z to a–z and nothing else: one character for one, so positions and
    lengths are unchanged (unlike a full Unicode ``lower``). The patterns' ``(?i)``
    is ASCII-only, so matching lower-case patterns on the folded text is the same
    test, run by the regex engine without case folding. Texts of one byte a character
    take the much faster ``lower``, which is the same for them."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def any_of(text: Column, body: str) -> Column:
    """Whether ``body`` occurs anywhere in the folded text. Plain alternatives are byte
    searches, other bodies a regex."""
    terms = literal_terms(body)
    if terms is None:
        return text.rlike(f"({body.lower()})")
    # a term that holds another one adds nothing
    terms = [t.lower() for t in dict.fromkeys(terms)]
    terms = [t for t in terms if not any(o != t and o in t for o in terms)]
    cond = None
    for t in terms:
        c = text.contains(t)
        cond = c if cond is None else cond | c
    return cond


#: stands between stretches that do not touch in the text; no term holds it
GAP = "\n\u0000\n"


class AnchorIndex:
    """Which part of a folded text the windows of a rule set cover.

    The text is cut once after every end of an anchor. A piece of at most ``window`` + 1
    characters is covered whole, of a longer one its first ``window`` + 1 characters are the
    allowed starts. ``inside`` joins the covered pieces, so a term in it starts and ends within
    them: a match for sure. ``reach`` has further characters after each window, so a term that
    is not in it is no match for sure. Only where a term is in ``reach`` but not ``inside`` (it
    crosses the end of a window) the anchored pattern itself decides.
    """

    def __init__(self, rules: RuleSet, name: str):
        self.anchors, self.window, self.name = rules.anchors.lower(), rules.window, name
        self.inside, self.reach = F.col(f"{name}_inside"), F.col(f"{name}_reach")

    def pieces(self, folded: Column) -> Column:
        """Pieces after each anchor; NULL without one."""
        pieces = F.split(folded, f"(?<=(?:{self.anchors}))")
        return F.when(any_of(folded, self.anchors), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def covered(self, pieces: Column, longest: int) -> Column:
        def keep(p: Column) -> Column:
            return F.when(F.length(p) <= longest, p).otherwise(F.concat(F.substring(p, 1, longest), F.lit(GAP)))

        return F.array_join(F.transform(pieces, keep), "")

    def add(self, df: DataFrame, folded: str, longest_term: int) -> DataFrame:
        """``df`` with the columns ``inside`` and ``reach``."""
        df = df.withColumn(f"{self.name}_pieces", self.pieces(F.col(folded)))
        pieces = F.col(f"{self.name}_pieces")
        cols = {
            f"{self.name}_inside": self.covered(pieces, self.window + 1),
            f"{self.name}_reach": self.covered(pieces, self.window + longest_term),
        }
        return df.withColumns(cols).drop(f"{self.name}_pieces")

    def matches(self, folded: Column, body: str) -> Column:
        # the nearest anchor that ends before a term decides, so the window of one anchor stops
        # where the next one ends: every character is tried after one anchor only
        stop = f"(?<!(?:{self.anchors}))" if literal_terms(self.anchors) else ""
        pattern = f"({self.anchors})(?s:.{stop}){{0,{self.window}}}({body.lower()})"
        if not _stays_in_line(body):
            return self.inside.isNotNull() & folded.rlike(pattern)
        return self.inside.isNotNull() & (any_of(self.inside, body) | (any_of(self.reach, body) & folded.rlike(pattern)))


def _stays_in_line(body: str) -> bool:
    """Whether a match of ``body`` is of bounded length and cannot hold a GAP."""
    return literal_terms(body) is not None or not re.search(r"[*+{]|\[\^|\(\?", body)


def longest_match(body: str) -> int:
    """A bound for the characters of a match: the length of the longest alternative as written."""
    return max(map(len, literal_terms(body) or [body]))


def bodies_of(rules: RuleSet) -> list[str]:
    return [b for c in rules.classes for b in (c.include, c.exclude) if b] + [b for _, b in rules.subtypes]


def label_column(folded: Column, index: AnchorIndex, rules: RuleSet) -> Column:
    """Ordered CASE cascade of ``rules``. NULL text falls through to the default."""
    expr = None
    for c in rules.classes:
        cond = index.matches(folded, c.include)
        if c.exclude is not None:
            cond = cond & ~F.coalesce(index.matches(folded, c.exclude), F.lit(False))
        expr = F.when(cond, F.lit(c.label)) if expr is None else expr.when(cond, F.lit(c.label))
    return expr.otherwise(F.lit(rules.default))


def subtype_column(folded: Column, index: AnchorIndex, rules: RuleSet) -> Column:
    """Independent first-match subtype cascade."""
    expr = None
    for name, body in rules.subtypes:
        cond = index.matches(folded, body)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr if expr is not None else F.lit(None).cast("string")


def check_rules(rules: RuleSet) -> None:
    # lower-casing a pattern must not change its meaning (no escapes like \S)
    if any("\\" in b for b in [rules.anchors, *bodies_of(rules)]):
        raise ValueError(f"rule set {rules.name}: escapes are not supported in anchors or terms")


def normalize_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def trim_all_ws(c: Column) -> Column:
    """Strip every leading/trailing whitespace character (``trim`` keeps newlines)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _section_pattern(anchor: str) -> str:
    return f"(?i){anchor}[:\\s]*([\\s\\S]+)"


def section(text: Column, anchor: str = "IMPRESSION") -> Column:
    """Text after the first ``anchor`` (case-insensitive) and any ``:``/space run,
    whitespace-trimmed; NULL when the anchor pattern does not match."""
    pat = _section_pattern(anchor)
    return F.when(text.rlike(pat), trim_all_ws(F.regexp_extract(text, pat, 1)))


def section_or_text(text: Column, max_len: int, anchor: str = "IMPRESSION") -> Column:
    """Section if the anchor matches, else the whole text; trimmed, whitespace runs
    collapsed to one space, first ``max_len`` characters (the review excerpt)."""
    body = F.coalesce(section(text, anchor), trim_all_ws(text))
    return F.substring(normalize_ws(body), 1, max_len)


def keyword_hint(text: Column, acute: str, stable: str, labels: tuple[str, str, str]) -> Column:
    """Three-way triage hint: acute and stable words / acute only / neither."""
    a = text.rlike(f"(?i)({acute})")
    s = text.rlike(f"(?i)({stable})")
    return F.when(a & s, F.lit(labels[0])).when(a, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def parse_reply(reply: Column, pos: str = "Positive", neg: str = "Negative") -> Column:
    """Free-text reply to a label: lower-cased, trimmed; 'positive' wins over
    'negative'; anything else is '?' + its first 15 characters."""
    t = F.lower(trim_all_ws(F.coalesce(reply, F.lit(""))))
    return (
        F.when(F.instr(t, "positive") > 0, F.lit(pos))
        .when(F.instr(t, "negative") > 0, F.lit(neg))
        .otherwise(F.concat(F.lit("?"), F.substring(t, 1, 15)))
    )


def prompt(template_head: str, text: Column) -> Column:
    """Request text = fixed instruction followed by the report."""
    return F.concat(F.lit(template_head), F.coalesce(text, F.lit("")))


# ---------------------------------------------------------------------------
# Fixed values. These term lists, anchors, windows and class names must equal
# the published labelling rules for results to match; they are stated here as
# plain text, in their original order.
# ---------------------------------------------------------------------------

NEG_TERMS_FULL = (
    "no acute intracranial|no acute abnormality|no intracranial|unremarkable|no acute process|"
    "no acute finding|no evidence of acute|no ct evidence|normal head ct|normal study|"
    "no acute traumatic|no hemorrhage|no fracture|no evidence of hemorrhage|"
    "no evidence of intracranial|without acute intracranial|without evidence of acute|"
    "without intracranial hemorrhage|without acute process|chronic small vessel|"
    "chronic lacunar|resolution of"
)
POS_TERMS_FULL = (
    "hemorrhage|hematoma|infarct|fracture|mass effect|midline shift|edema|hydrocephalus|"
    "abscess|tumor|bleed|pneumocephalus|hypoxic brain|ischemi"
)
NEGATION_VETO = (
    "(no |without |chronic |old |prior |resolved )(acute |evidence of |intracranial )?"
    "(hemorrhage|hematoma|fracture|edema|bleed|infarct)"
)
POST_SURGICAL_TERMS = (
    "post.surgical|post-surgical|postoperative|unchanged from prior|status post|"
    "craniotomy|surgical changes"
)
SUBTYPES_FULL = (
    ("Hemorrhage", "hemorrhage|hematoma|bleed"),
    ("Infarct", "infarct|ischemi"),
    ("Fracture", "fracture"),
    ("Mass Effect", "mass effect|midline shift|herniation"),
    ("Hydrocephalus", "hydrocephalus"),
)
NEG_TERMS_REDUCED = (
    "no acute intracranial|no acute abnormality|unremarkable|no acute process|no acute "
    "finding|normal head ct|normal study|no hemorrhage|no fracture|without acute"
)
POS_TERMS_REDUCED = (
    "hemorrhage|hematoma|infarct|fracture|mass effect|midline shift|edema|hydrocephalus|"
    "herniation|bleed|ischemi"
)
CT_EXAM_NAMES = ("CT HEAD W/O CONTRAST", "CT HEAD W/ & W/O CONTRAST", "CT HEAD W/ CONTRAST")
TRIAGE_ACUTE = (
    "hemorrhage|hematoma|infarct|fracture|mass effect|midline shift|edema|hydrocephalus|"
    "herniation|ischemi|bleed|pneumocephalus|abscess"
)
TRIAGE_STABLE = (
    "stable|unchanged|chronic|old|prior|previously|resolution|resolved|improved|decreased|"
    "evolving|postsurgical|post-surgical|postoperative|craniotomy|status post|burr hole"
)
TRIAGE_LABELS = (
    "acute-finding-word + stable/chronic-word (needs your call)",
    "acute finding word present",
    "no acute keyword (LLM may have over-called)",
)
REPORT_PROMPT = (
    "You are labeling a head CT radiology report. Based ONLY on the IMPRESSION "
    "and FINDINGS, classify the scan as exactly one word: 'Positive' if it shows "
    "an ACUTE clinically significant intracranial finding (hemorrhage, infarct, "
    "acute fracture, mass effect, midline shift, acute edema, hydrocephalus), or "
    "'Negative' if there is no acute finding. Even if the report also says 'no "
    "hemorrhage', answer Positive if ANY acute finding is present. Answer with "
    "only the single word.\n\nREPORT:\n"
)

# Rule set A: IMPRESSION or FINDINGS anchor, 800-character window, four classes.
RULES_A = RuleSet(
    name="A",
    anchors="IMPRESSION|FINDINGS",
    window=800,
    classes=(
        ClassRule("Negative", NEG_TERMS_FULL),
        ClassRule("Positive", POS_TERMS_FULL, NEGATION_VETO),
        ClassRule("Post-surgical/Unchanged", POST_SURGICAL_TERMS),
    ),
    default="Unclear",
    subtypes=SUBTYPES_FULL,
)

# Rule set B: IMPRESSION anchor only, 500-character window, same terms.
RULES_B = RuleSet(
    name="B",
    anchors="IMPRESSION",
    window=500,
    classes=RULES_A.classes,
    default="Unclear",
    subtypes=SUBTYPES_FULL,
)

# Rule set C (audit labeller): Positive = positive terms and no negative terms.
RULES_C = RuleSet(
    name="C",
    anchors="impression|findings",
    window=800,
    classes=(
        ClassRule("Positive", POS_TERMS_REDUCED, NEG_TERMS_REDUCED),
        ClassRule("Negative", NEG_TERMS_REDUCED),
    ),
    default="Unclear",
)

# Stand-in rule sets for the synthetic multi-language `documents` table (our own
# choice of anchors and terms; same cascade shape as rule set A).
STANDIN_WIDE = RuleSet(
    name="wide",
    anchors="released|that|license",
    window=400,
    classes=(
        ClassRule("Negative", "license|of the "),
        ClassRule("Positive", "there|then", "(in |of )(the )?(there|then)"),
        ClassRule("Third", "erat|tion"),
    ),
    default="Unclear",
    subtypes=(("There", "there"), ("Then", "then"), ("Erat", "erat")),
)
STANDIN_NARROW = RuleSet(
    name="narrow",
    anchors="that",
    window=150,
    classes=STANDIN_WIDE.classes,
    default="Unclear",
    subtypes=STANDIN_WIDE.subtypes,
)
STANDIN_REDUCED = RuleSet(
    name="reduced",
    anchors="released|that|license",
    window=400,
    classes=(
        ClassRule("Positive", "there|then", "license|of the "),
        ClassRule("Negative", "license|of the "),
    ),
    default="Unclear",
)
