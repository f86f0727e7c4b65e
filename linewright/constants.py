"""Word lists, code point sets and key names that results depend on."""

from __future__ import annotations

# Fixed values. Split names, in the order in which the label files of an export are read.
SPLITS = ("train", "val", "test")

# Fixed values. Keys of the drop counters, in the order in which the checks are applied.
DROP_REASONS = (
    "missing_image",
    "invalid_yoruba",
    "label_too_short",
    "label_too_long",
    "non_whitelisted_codepoint",
    "image_too_tall",
)

# Fixed values. Letters that do not occur in the target orthography.
FOREIGN_LETTERS = "cqvxz"

# Fixed values. Months and list numerals that mark a line as foreign.
MONTHS_AND_NUMERALS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december", "iv", "vi", "vii", "viii", "ix",
)

# Fixed values. Foreign words that mark a line as foreign.
FOREIGN_WORDS = (
    "chest", "child", "breeze", "chair", "cup", "bicycle", "village", "zebra", "fox", "camel",
    "the", "and", "of", "to", "in", "is", "was", "for", "on", "are", "with",
)

# Fixed values. Code points of the target orthography: printable ASCII and the listed others.
WHITELIST = frozenset(
    [
        *range(0x20, 0x7F),
        0x00A0,
        0x0300, 0x0301, 0x0304, 0x0323,
        0x00C0, 0x00C1, 0x00C8, 0x00C9, 0x00CC, 0x00CD, 0x00D2, 0x00D3, 0x00D9, 0x00DA,
        0x00E0, 0x00E1, 0x00E8, 0x00E9, 0x00EC, 0x00ED, 0x00F2, 0x00F3, 0x00F9, 0x00FA,
        0x0100, 0x0101, 0x0112, 0x0113, 0x012A, 0x012B, 0x0143, 0x0144, 0x014C, 0x014D, 0x016A, 0x016B,
        0x01F8, 0x01F9,
        0x1E62, 0x1E63, 0x1EB8, 0x1EB9, 0x1ECC, 0x1ECD,
        0x2013, 0x2018, 0x2019,
    ]
)

# Fixed values. Names under which combining marks are counted; all others are counted as U+XXXX.
MARK_NAMES = {
    "̀": "combining_grave",
    "́": "combining_acute",
    "̣": "combining_dot_below",
}

# Fixed values. Precomposed letters that are counted one by one.
PRECOMPOSED = "ẹọṣẸỌṢàáèéìíòóùúÀÁÈÉÌÍÒÓÙÚń"

# Fixed values. Coarse block labels as (first, last, label); the first range that holds the code point decides.
BLOCKS = (
    (0x0000, 0x007F, "ascii"),
    (0x0080, 0x00FF, "latin-1-supplement"),
    (0x0100, 0x017F, "latin-extended-a"),
    (0x0180, 0x024F, "latin-extended-b"),
    (0x0300, 0x036F, "combining-diacritics"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x04FF, "cyrillic"),
    (0x1E00, 0x1EFF, "latin-extended-additional"),
    (0x2000, 0x206F, "general-punctuation"),
    (0x2070, 0x20CF, "superscripts-and-currency"),
    (0x2100, 0x21FF, "letterlike-symbols"),
    (0xFB00, 0xFB4F, "alphabetic-presentation-forms"),
    (0x0000, 0x07FF, "other-bmp-low"),
)
OTHER_BLOCK = "other"

# Fixed values. Kinds of recogniser for which a "phantom head" has no meaning.
HEADLESS_KINDS = ("tesseract", "qwen_vl", "qwen2_vl", "paddleocr_vl")

# Fixed values. Columns of a new metrics log.
METRICS_COLUMNS = (
    "model", "split", "n", "cer", "wer", "der", "der_n", "der_insertion_rate", "phantom", "meta_path", "timestamp",
)

# Fixed values. Statuses of the provenance audit and components of a parameter state.
AUDIT_STATUSES = ("ok", "phantom", "no_meta", "stale")
COMPONENTS = ("head", "backbone", "other")

# Fixed values. The white space that splits words and is stripped from ends: the 29 Unicode space characters.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
