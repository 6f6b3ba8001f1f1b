"""Text scalars (P-01 .. P-19) as built-in Column expressions.

Java regexes are ASCII by default; ``(?U)`` makes ``\\w`` and ``\\b``
Unicode like Python's (H-10). Whitespace for ``str.strip``/``str.split``
(H-1) is spelled out as the exact set of characters ``str.isspace``
accepts, which also avoids Unicode property lookups per character.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python whitespace (str.isspace) as a Java character class.
PY_SPACE = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a"
            r"\u2028\u2029\u202f\u205f\u3000]")

# Fence and name patterns.
FENCE_STRIP = r"(?U)```(?:python)?\s*\n?|```"            # P-01, remove all
FENCE_BODY = r"(?sU)```(?:python)?\s*(.*?)```"          # P-02, first closed fence
ENTRY_LOOSE = r"(?U)\bassert\s+(\w+)\s*\("             # P-04
ENTRY_STRICT = r"(?U)assert\s+([A-Za-z_]\w*)\s*\("     # P-05

# Prompt texts.
ENV_SYSTEM_PROMPT = (
    "You are an expert Python programmer. Write ONLY the complete Python function "
    "(including its `def` line). No markdown, no code fences, no explanations.")
RFT_SYSTEM_PROMPT = (
    "You are an expert Python programmer. Write a single, correct, self-contained "
    "Python function that solves the problem. Respond with only the function inside "
    "a ```python code block.")
V1_SYSTEM_PROMPT = ("You are an expert Python programmer. Write ONLY the Python function. "
                    "No markdown, no code fences, no explanations.")
V1_BODY_SYSTEM_PROMPT = ("Complete the Python function. Write ONLY the function body. "
                         "No markdown, no code fences.")
# P-07 and P-08: the parts of the turn prompts around entry point, prompt, attempt and feedback.
FIRST_TURN = ("Solve this Python task. The function must be named `", "`.\n\n")
REVISION = ("\n\nYour previous attempt was incorrect:\n\n", "\n\n",
            "\n\nReturn a corrected, complete function.")
SYNTAX_FEEDBACK = ("Your code failed to parse (SyntaxError). "
                   "Return a syntactically valid function.")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (H-1)."""
    return F.regexp_replace(_c(x), rf"\A{PY_SPACE}+|{PY_SPACE}+\z", "")


def py_split(x) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty strings (H-4)."""
    return F.filter(F.split(_c(x), rf"{PY_SPACE}+"), lambda w: w != "")


def strip_fences(x) -> Column:
    """P-01: remove every markdown fence, then strip."""
    return py_strip(F.regexp_replace(_c(x), FENCE_STRIP, ""))


def extract_code(x) -> Column:
    """P-02: body of the first closed fence, else the whole text; stripped."""
    c = _c(x)
    return py_strip(F.when(c.rlike(FENCE_BODY), F.regexp_extract(c, FENCE_BODY, 1)).otherwise(c))


def messages_to_text(messages) -> Column:
    """P-03 for a message-list column: content of the last message
    (null content -> ''), empty list -> '[]', null -> its string form."""
    m = _c(messages)
    last = F.try_element_at(m, F.lit(-1))
    return (F.when(m.isNull(), F.lit("None"))
            .when(F.size(m) == 0, F.lit("[]"))
            .otherwise(F.coalesce(last.getField("content"), F.lit(""))))


def _first_capture(tests, pattern: str) -> Column:
    caps = F.transform(_c(tests), lambda t: F.regexp_extract(t, pattern, 1))
    return F.get(F.filter(caps, lambda s: s != ""), 0)


def entry_from_asserts(tests) -> Column:
    """P-04: name called by the first matching assert, else ''."""
    return F.coalesce(_first_capture(tests, ENTRY_LOOSE), F.lit(""))


def function_name(tests) -> Column:
    """P-05: stricter name rule; null when no test matches."""
    return _first_capture(tests, ENTRY_STRICT)


def first_turn_prompt(entry_point, prompt) -> Column:
    """P-07."""
    return F.concat(F.lit(FIRST_TURN[0]), _c(entry_point), F.lit(FIRST_TURN[1]), _c(prompt))


def revision_prompt(entry_point, prompt, last_action, feedback) -> Column:
    """P-08: first-turn text, plus the last attempt and feedback when the
    feedback is non-empty."""
    fb = _c(feedback)
    base = first_turn_prompt(entry_point, prompt)
    extra = F.concat(F.lit(REVISION[0]), _c(last_action), F.lit(REVISION[1]), fb,
                     F.lit(REVISION[2]))
    return F.when(F.coalesce(F.length(fb), F.lit(0)) > 0, F.concat(base, extra)).otherwise(base)


def revision_text(entry_point: str, prompt: str, last_action: str, feedback: str | None) -> str:
    """P-08 for one row of plain strings (the streaming state machine)."""
    text = FIRST_TURN[0] + entry_point + FIRST_TURN[1] + prompt
    if feedback:
        text += REVISION[0] + last_action + REVISION[1] + feedback + REVISION[2]
    return text


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rft_messages(text, fn) -> Column:
    """P-09: [system, user]; user text stripped, name sentence when known."""
    f = _c(fn)
    user = F.when(F.coalesce(F.length(f), F.lit(0)) > 0,
                  F.concat(py_strip(text), F.lit("\n\nThe function must be named `"), f, F.lit("`.")))
    user = user.otherwise(py_strip(text))
    return F.array(_msg("system", F.lit(RFT_SYSTEM_PROMPT)), _msg("user", user))


def v1_messages(text, fn) -> Column:
    """P-10: the name sentence goes into the system message."""
    f = _c(fn)
    sys = F.when(F.coalesce(F.length(f), F.lit(0)) > 0,
                 F.concat(F.lit(V1_SYSTEM_PROMPT + " The function must be named `"), f, F.lit("`.")))
    sys = sys.otherwise(F.lit(V1_SYSTEM_PROMPT))
    return F.array(_msg("system", sys),
                   _msg("user", F.concat(F.lit("Solve this Python task:\n\n"), _c(text))))


def benchmark_messages(prompt, entry_point, form: str) -> Column:
    """P-11: ``form='body'`` asks for the body only; ``form='named'`` asks
    for the whole function with its name."""
    if form == "body":
        return F.array(_msg("system", F.lit(V1_BODY_SYSTEM_PROMPT)),
                       _msg("user", F.concat(F.lit("Complete this function:\n\n"), _c(prompt))))
    if form == "named":
        return F.array(_msg("system", F.lit(RFT_SYSTEM_PROMPT)),
                       _msg("user", F.concat(_c(prompt), F.lit("\n\nThe function must be named `"),
                                             _c(entry_point), F.lit("`."))))
    raise ValueError(f"unknown form {form!r}")


def turn_messages(prompt_text) -> Column:
    """P-12: system + user pair for any turn."""
    return F.array(_msg("system", F.lit(ENV_SYSTEM_PROMPT)), _msg("user", _c(prompt_text)))


def test_program(style: str, code, test, setup=None, entry_point=None, prompt=None) -> Column:
    """P-13: the four ways a test program is assembled."""
    if style == "env":
        return F.concat(_c(code), F.lit("\n\n"), _c(test))
    if style == "setup":
        return F.concat(F.coalesce(_c(setup), F.lit("")), F.lit("\n"), _c(code), F.lit("\n"),
                        _c(test), F.lit("\n"))
    if style == "check":
        return F.concat(_c(code), F.lit("\n"), _c(test), F.lit("\ncheck("), _c(entry_point),
                        F.lit(")\n"))
    if style == "prompt_check":
        return F.concat(_c(prompt), F.lit("\n"), _c(code), F.lit("\n\n"), _c(test),
                        F.lit("\n\ncheck("), _c(entry_point), F.lit(")"))
    raise ValueError(f"unknown program style {style!r}")


def test_error(passed, stderr, syntax_ok=None) -> Column:
    """P-15: '' when passed, else stderr or 'non-zero exit'; a syntax
    failure reads 'SyntaxError' for every test."""
    err = F.when(_c(passed), F.lit("")).otherwise(
        F.coalesce(F.nullif(_c(stderr), F.lit("")), F.lit("non-zero exit")))
    if syntax_ok is None:
        return err
    return F.when(~_c(syntax_ok), F.lit("SyntaxError")).otherwise(err)


def failure_feedback(syntax_ok, first_fail_test, first_fail_error) -> Column:
    """P-14: parse message; else first failing test with the last 400
    characters of its stripped error ('assertion failed' when blank); else ''."""
    err = py_strip(F.coalesce(_c(first_fail_error), F.lit("")))
    err = F.when(F.length(err) > 0, F.substring(err, -400, 400)).otherwise(F.lit("assertion failed"))
    fail = F.concat(F.lit("Your code failed this test:\n"), _c(first_fail_test), F.lit("\nError:\n"), err)
    return (F.when(~_c(syntax_ok), F.lit(SYNTAX_FEEDBACK))
            .when(_c(first_fail_test).isNotNull(), fail)
            .otherwise(F.lit("")))


def preview(x, n: int, prefix: str = "  ") -> Column:
    """P-16: first ``n`` characters, non-blank lines indented."""
    return F.regexp_replace(F.substring(_c(x), 1, n), r"(?m)^(?=[^\n]*\S)", prefix)


def signed_delta(delta, is_base) -> Column:
    """P-17: '+0.000' style, an em dash for the base row."""
    return F.when(_c(is_base), F.lit("—")).otherwise(F.format_string("%+.3f", _c(delta)))


def label_or_model(label, model) -> Column:
    """P-18."""
    return F.coalesce(F.nullif(_c(label), F.lit("")), _c(model))


def setup_or_empty(setup) -> Column:
    """P-19."""
    return F.coalesce(_c(setup), F.lit(""))
