"""Render styles, colours, names and prompts as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.geometry import half_even
from pagestrata.functions.text import strip

# Fixed values
FONT_MODES = ("inherit", "fit", "fixed")
WRITING_MODES = ("inherit", "auto", "horizontal", "vertical_rl")
COLOR_MODES = ("inherit", "auto", "custom")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
DARK_TEXT_MEDIAN, DARK_MASK_MEDIAN, DARK_MEAN, COMPLEX_STD = 132.0, 140.0, 100.0, 28.0
OUTSIDE_STROKE = 1.35
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]+'
DEFAULT_NAME_PATTERN = "{index:04d}_{stem}"
NAME_FIELDS = ("index", "page_number", "stem", "source_stem", "project", "stage")
ANSWER_PREFIXES = ("The best matching font is ", "Best match: ", "Font: ", "I recommend ")
OCR_PROVIDERS = {
    "paddleocr_vl_llama": "paddleocr_vl_llama", "paddleocr_vl": "paddleocr_vl_llama", "paddleocr_vl_local": "paddleocr_vl_llama",
    "paddleocr": "paddleocr_vl_llama", "deepseek_ocr_llama": "deepseek_ocr_llama", "deepseek_ocr": "deepseek_ocr_llama",
    "deepseek": "deepseek_ocr_llama", "deepseek_ocr_gguf": "deepseek_ocr_llama", "deepseek_ocr_llamacpp": "deepseek_ocr_llama",
    "deepseek_ocr_llama_cpp": "deepseek_ocr_llama", "chrome_lens": "chrome_lens", "chrome_lens_ocr": "chrome_lens",
    "chrome_lens_local": "chrome_lens", "chrome_lens_browser": "chrome_lens", "chromelens": "chrome_lens", "chrome": "chrome_lens",
    "lens": "chrome_lens",
}
TRANSLATORS = {
    "gemini": "gemini", "local llm": "local_llm", "local_llm": "local_llm", "deepseek": "deepseek", "openai compatible": "openai_compatible",
    "openai_compatible": "openai_compatible", "google": "google", "nllb": "nllb", "baidu": "baidu", "bing": "bing",
}
LANGUAGES = {
    "en": "English", "eng": "English", "english": "English", "ja": "Japanese", "jpn": "Japanese", "japanese": "Japanese",
    "ko": "Korean", "kor": "Korean", "korean": "Korean", "zh": "Chinese", "chi": "Chinese", "zho": "Chinese", "chinese": "Chinese",
    "simplified chinese": "Chinese", "traditional chinese": "Chinese", "vi": "Vietnamese", "vie": "Vietnamese",
    "vietnamese": "Vietnamese", "fr": "French", "french": "French", "de": "German", "german": "German", "es": "Spanish",
    "spanish": "Spanish", "th": "Thai", "thai": "Thai", "ru": "Russian", "russian": "Russian",
}
NO_LANGUAGE = ("auto", "unknown", "none", "null")
DEFAULT_OUTPUT_CONTRACT = (
    "Return only the structured result requested by the caller.\n"
    "- Preserve every page key exactly as provided.\n"
    "- Preserve item count exactly.\n"
    "- Preserve item order exactly.\n"
    "- Do not merge, split, drop, or invent items.\n"
    "- Empty input items should map to empty output strings.\n"
    "- Do not add explanations, notes, markdown, or commentary outside the structured result."
)
TASK_TEXT = "You are a manga/comic translator.\nTranslate from %s to %s.\nPreserve meaning, tone, character voice, and reading flow."
DEFAULT_STYLE_TEXT = "Use clear, natural manga dialogue with concise speech-bubble fit phrasing."
DEFAULT_CUSTOM_TEXT = "Provide translation instructions for the target tone, terminology, and voice."


def _lookup(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def normal_provider(name: Column, fallback: str = "paddleocr_vl_llama") -> Column:
    key = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")
    return F.coalesce(_lookup(OCR_PROVIDERS)[key], F.lit(fallback))


def normal_translator(name: Column) -> Column:
    return F.coalesce(_lookup(TRANSLATORS)[F.lower(F.trim(F.coalesce(name, F.lit(""))))], F.lit("google"))


def normal_language(name: Column) -> Column:
    """Language name; NULL for none or automatic; unknown names with capitals."""
    cleaned = strip(F.coalesce(name, F.lit("")))
    key = F.lower(cleaned)
    words = F.filter(F.split(cleaned, r"[\s_-]+"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
    return F.when((cleaned == "") | key.isin(*NO_LANGUAGE), F.lit(None)).otherwise(F.coalesce(_lookup(LANGUAGES)[key], titled))


# ---------------------------------------------------------------- colours and styles


def parse_color(text: Column) -> tuple[Column, Column]:
    """Colour as three numbers, and an error message; both NULL for automatic."""
    raw = strip(F.coalesce(text, F.lit("")))
    auto = (raw == "") | (F.lower(raw) == "auto")
    hexed = raw.rlike("^#[0-9A-Fa-f]{6}$")
    parts = F.transform(F.split(raw, ","), lambda p: strip(p).try_cast("int"))
    listed = F.contains(raw, F.lit(",")) & (F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull())
    from_hex = F.array(*(F.conv(F.substring(raw, at, 2), 16, 10).cast("int") for at in (2, 4, 6)))
    clamped = F.transform(parts, lambda p: F.greatest(F.lit(0), F.least(F.lit(255), p)))
    color = F.when(auto, F.lit(None)).when(hexed, from_hex).when(listed, clamped)
    return color, F.when(~auto & ~hexed & ~listed, F.concat(F.lit("Invalid color value: "), raw))


def choice(value: Column, allowed: tuple[str, ...]) -> Column:
    cleaned = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(cleaned.isin(*allowed), cleaned).otherwise(allowed[0])


def whole_or_zero(value: Column) -> Column:
    return F.greatest(F.coalesce(value.cast("string").try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def flag_or_null(value: Column) -> Column:
    cleaned = F.lower(F.trim(value.cast("string")))
    return F.when(cleaned.isin(*TRUE_WORDS), F.lit(True)).when(cleaned.isin(*FALSE_WORDS), F.lit(False))


def number_or_null(value: Column, least: float = 0.0) -> Column:
    parsed = value.cast("string").try_cast("double")
    return F.when(parsed >= least, parsed)


def color_or_null(value: Column) -> Column:
    cut = F.transform(F.slice(value, 1, 3), lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))))
    return F.when((F.size(value) >= 3) & ~F.exists(cut, lambda c: c.isNull()), cut)


def style_defaults(df: DataFrame) -> DataFrame:
    """Override columns coerced to their kinds; ``active`` when any of them says something."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = df.withColumns({
        "enabled": F.coalesce("enabled", F.lit(False)),
        **{c: text(c) for c in ("render_text_override", "font_name", "font_path")},
        "font_size_mode": choice(F.col("font_size_mode"), FONT_MODES),
        "writing_mode": choice(F.col("writing_mode"), WRITING_MODES),
        "text_color_mode": choice(F.col("text_color_mode"), COLOR_MODES),
        **{c: whole_or_zero(F.col(c)) for c in ("fixed_font_size", "min_font_size", "max_font_size")},
        "stroke_enabled": flag_or_null(F.col("stroke_enabled")),
        "stroke_width": number_or_null(F.col("stroke_width")),
        "line_spacing_ratio": number_or_null(F.col("line_spacing_ratio"), 0.01),
        "text_color": color_or_null(F.col("text_color")),
        "stroke_color": color_or_null(F.col("stroke_color")),
    })
    said = F.col("enabled") | F.col("stroke_enabled").isNotNull() | F.col("text_color").isNotNull() | F.col("stroke_color").isNotNull()
    for c in ("render_text_override", "font_name", "font_path"):
        said = said | (F.col(c) != "")
    for c in ("fixed_font_size", "min_font_size", "max_font_size", "stroke_width", "line_spacing_ratio"):
        said = said | (F.coalesce(F.col(c), F.lit(0)) != 0)
    for c in ("font_size_mode", "writing_mode", "text_color_mode"):
        said = said | (F.col(c) != "inherit")
    return out.withColumn("active", said)


def effective_style(df: DataFrame, config: dict) -> DataFrame:
    """Override, then configuration; a fixed size sets both limits.

    The frame holds coerced override columns and ``translated_text``; ``config`` the
    defaults ``min_font_size, max_font_size, stroke_enabled, stroke_width, auto_color,
    text_color, stroke_color, line_spacing_ratio``.
    """
    low, high = F.lit(config["min_font_size"]).cast("long"), F.lit(config["max_font_size"]).cast("long")
    fixed_mode = F.col("font_size_mode") == "fixed"
    fixed = fixed_mode & (F.col("fixed_font_size") > 0)
    minimum = F.when(fixed, F.col("fixed_font_size")).when(~fixed_mode & (F.col("min_font_size") > 0), F.col("min_font_size")).otherwise(low)
    maximum = F.when(fixed, F.col("fixed_font_size")).when(~fixed_mode & (F.col("max_font_size") > 0), F.col("max_font_size")).otherwise(high)
    mode = F.col("text_color_mode")
    as_color = lambda c: F.lit(None).cast("array<int>") if c is None else F.array(*(F.lit(int(x)) for x in c))
    override = F.col("render_text_override")
    return df.withColumns({
        "eff_min": minimum, "eff_max": F.greatest(minimum, maximum),
        "eff_stroke_enabled": F.coalesce("stroke_enabled", F.lit(config["stroke_enabled"])),
        "eff_stroke_width": F.coalesce("stroke_width", F.lit(config["stroke_width"]).cast("double")),
        "eff_auto_color": F.when(mode == "auto", True).when(mode == "custom", False).otherwise(F.lit(config["auto_color"])),
        "eff_text_color": F.when(mode == "auto", F.lit(None)).when(mode == "custom", F.coalesce("text_color", as_color(config["text_color"]))).otherwise(as_color(config["text_color"])),
        "eff_stroke_color": F.when(mode == "auto", as_color(config["stroke_color"])).otherwise(F.coalesce("stroke_color", as_color(config["stroke_color"]))),
        "eff_text": F.when(strip(override) != "", override).otherwise(F.coalesce("translated_text", F.lit(""))),
        "eff_line_spacing": F.coalesce(F.when(F.col("line_spacing_ratio") != 0, F.col("line_spacing_ratio")), F.lit(config["line_spacing_ratio"])),
    })


def text_color_rule(median: Column, std: Column, min_side: Column, dark: Column, outside: Column) -> dict[str, Column]:
    """Text and stroke colour and stroke width for the background of a region."""
    one = F.lit(1).cast("long")
    base, most = F.greatest(one, half_even(min_side / 40.0)), F.greatest(one, half_even(min_side * 0.07))
    is_dark = F.coalesce(dark, median < DARK_TEXT_MEDIAN)
    complex_ = std >= COMPLEX_STD
    extra = F.when(is_dark, (complex_ | outside).cast("long")).otherwise(outside.cast("long"))
    width = F.least(most, F.greatest(one, base + extra))
    return {
        "text_color": F.when(is_dark, "255,255,255").otherwise("0,0,0"),
        "stroke_color": F.when(is_dark, "0,0,0").when(outside | complex_, "255,255,255"),
        "stroke_width": F.greatest(one, half_even(F.when(outside, width * OUTSIDE_STROKE).otherwise(width * 1.0))),
    }


# ---------------------------------------------------------------- names


def safe_name(value: Column, fallback: Column) -> Column:
    cleaned = strip(F.regexp_replace(F.coalesce(value, F.lit("")), ILLEGAL_NAME_CHARS, "_"))
    cleaned = F.regexp_replace(cleaned, r"^[. ]+|[. ]+$", "")
    return F.when(cleaned == "", fallback).otherwise(cleaned)


def export_name(pattern: str, fields: dict[str, Column]) -> Column:
    """File name from a pattern such as ``{index:04d}_{stem}``, read once on the driver.

    A pattern with unknown fields or formats gives the default name.
    """
    default = F.concat(F.format_string("%04d", fields["index"]), F.lit("_"), F.coalesce(
        F.when(fields["source_stem"] != "", fields["source_stem"]), F.when(fields["stem"] != "", fields["stem"]), F.lit("page")))
    try:
        parts: list[Column] = []
        for literal, name, spec, conversion in string.Formatter().parse(pattern or DEFAULT_NAME_PATTERN):
            if literal:
                parts.append(F.lit(literal))
            if name is None:
                continue
            numeric = name in ("index", "page_number")
            if name not in NAME_FIELDS or conversion or (spec and not numeric):
                raise ValueError(pattern)
            if not numeric:
                parts.append(fields[name])
            elif not spec or spec == "d":
                parts.append(fields[name].cast("string"))
            elif spec.rstrip("d").isdigit():
                width = spec.rstrip("d")
                parts.append(F.format_string(f"%{width}d", fields[name]))
            else:
                raise ValueError(pattern)
        return safe_name(F.concat(*parts) if parts else F.lit(""), default)
    except ValueError:
        return safe_name(default, F.lit("page"))


def clean_answer(answer: Column) -> Column:
    """Model answer without quotes and a known opening."""
    text = strip(F.regexp_replace(F.coalesce(answer, F.lit("")), "[\"']", ""))
    for prefix in ANSWER_PREFIXES:
        text = F.when(F.lower(text).startswith(prefix.lower()), strip(text.substr(F.lit(len(prefix) + 1), F.length(text)))).otherwise(text)
    return text


# ---------------------------------------------------------------- prompts


def build_prompt(
    source: Column, target: Column, mode: Column, style_name: Column, style_text: Column, user: Column, custom: Column,
    notes: Column, contract: Column,
) -> Column:
    """Titled prompt sections in order; blank ones are left out."""
    filled = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", strip(c))
    titled = lambda title, body: F.concat(title, F.lit(":\n"), body)
    full = F.lower(F.trim(F.coalesce(mode, F.lit("")))) == "full_custom_prompt"
    task = F.format_string(TASK_TEXT, F.coalesce(filled(source), F.lit("ja")), F.coalesce(filled(target), F.lit("en")))
    style = titled(F.concat(F.lit("Style Instructions ("), style_name, F.lit(")")), F.coalesce(filled(style_text), F.lit(DEFAULT_STYLE_TEXT)))
    override = titled(F.lit("Custom Prompt Override"), F.coalesce(filled(custom), filled(style_text), F.lit(DEFAULT_CUSTOM_TEXT)))
    return F.concat_ws(
        "\n\n", titled(F.lit("Role / Task"), task), F.when(full, override).otherwise(style),
        F.when(~full, titled(F.lit("User Extra Instructions"), filled(user))),
        titled(F.lit("Project Translation Notes"), filled(notes)),
        titled(F.lit("Output Contract"), F.coalesce(filled(contract), F.lit(DEFAULT_OUTPUT_CONTRACT))),
    )
