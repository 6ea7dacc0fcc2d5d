"""String expressions: whitespace strip, prompt templates, response extraction.

All JVM-side (``regexp_replace``/``concat``/``substring_index``), so they stay in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour).
# Python str.strip() removes exactly these 29 code points:
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CLASS = (
    "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Prompt template pieces.
INSTRUCTION_HEADER = "### Instruction:\n"
INPUT_HEADER = "\n\n### Input:\n"
RESPONSE_HEADER = "\n\n### Response:\n"
# End-of-text marker text.
EOT_TEXT = "<|endoftext|>"

# the look-behind starts the trailing run at its head only, so long inner runs cost nothing
_STRIP_RE = f"^{PY_WHITESPACE_CLASS}+|(?<!{PY_WHITESPACE_CLASS}){PY_WHITESPACE_CLASS}+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """NULL -> '' then strip Python whitespace at both ends.

    ``trim`` only removes spaces, so the explicit class is required.
    """
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), _STRIP_RE, "")


def format_prompt(instruction, inp) -> Column:
    """Instruction prompt (P3): three sections when the stripped input is non-empty."""
    ins = py_strip(instruction)
    i = py_strip(inp)
    with_input = F.concat(F.lit(INSTRUCTION_HEADER), ins, F.lit(INPUT_HEADER), i,
                          F.lit(RESPONSE_HEADER))
    without = F.concat(F.lit(INSTRUCTION_HEADER), ins, F.lit(RESPONSE_HEADER))
    return F.when(F.length(i) > 0, with_input).otherwise(without)


def inference_prompt(instruction) -> Column:
    """Generation prompt (P4): two-section form, instruction NOT stripped."""
    return F.concat(F.lit(INSTRUCTION_HEADER), _c(instruction), F.lit(RESPONSE_HEADER))


def extract_response(full_text, prompt) -> Column:
    """Drop the prompt by character count, cut at the first marker, strip."""
    rest = _c(full_text).substr(F.length(_c(prompt)) + 1, F.lit(2147483647))
    head = F.substring_index(rest, EOT_TEXT, 1)
    return py_strip(head)
