from .text import (  # noqa: F401
    RULES_A,
    RULES_B,
    RULES_C,
    STANDIN_NARROW,
    STANDIN_REDUCED,
    STANDIN_WIDE,
    AnchorIndex,
    ClassRule,
    RuleSet,
    label_column,
    parse_reply,
    section,
    section_or_text,
    subtype_column,
)
