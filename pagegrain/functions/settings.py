"""Names of settings brought to one form, and what models can do by their listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cleaned

#: For each setting its default, the other names of its values, and the values it may have (None: any).
SETTINGS: dict[str, tuple[str, dict[str, tuple[str, ...]], tuple[str, ...] | None]] = {
    "parse_provider": ("local", {}, None),
    "ocr_provider": ("auto", {"aiocr": ("remote", "ai"), "paddle_local": ("paddle-local", "local_paddle")}, None),
    "layout_provider": ("openai", {"openai": ("domestic", "siliconflow", "openai-compatible", "openai_compatible"), "claude": ("anthropic",)}, None),
    "parse_type": ("paddle_vl", {"general": ("default", "normal", "ordinary", "common"), "paddle_vl": ("paddle-vl", "paddleocr-vl", "paddleocr_vl", "vl")}, ("general", "paddle_vl")),
    "ai_provider": ("auto", {"openai": ("openai_compatible", "openai-compatible")}, None),
    "chain_mode": (
        "direct",
        {"direct": ("prompt", "prompt_ocr", "model_direct", "direct_ai"), "doc_parser": ("docparser", "doc-parse", "structured"), "layout_block": ("layout", "layout_block_ocr", "local_layout")},
        ("direct", "doc_parser", "layout_block"),
    ),
    "layout_model": ("pp_doclayout_v3", {"pp_doclayout_v3": ("pp-doclayoutv3", "pp_doclayoutv3", "pp_doclayout", "pp-doclayout-v3")}, ("pp_doclayout_v3",)),
    "geometry_mode": ("auto", {"direct_ai": ("direct", "ai", "requested"), "local_tesseract": ("local", "tesseract", "hybrid_local")}, ("auto", "local_tesseract", "direct_ai")),
    "erase_mode": ("fill", {}, ("smart", "fill")),
    "page_mode": ("segmented", {"segmented": ("chunk", "chunked", "split", "blocks"), "fullpage": ("page", "full", "full_page")}, ("segmented", "fullpage")),
    "generation_mode": (
        "standard",
        {"standard": ("default", "normal", "balanced", "quality"), "fast": ("speed", "speed_first", "speed-first", "fast_experimental", "experimental_fast"), "turbo": ("ultra", "extreme", "turbo_fast", "turbo-fast")},
        ("standard", "fast", "turbo"),
    ),
}

#: Tokens of a model's listing that mean images in, and texts out.
IMAGE_INPUT = ("image", "images", "vision", "visual", "multimodal", "input-image", "input_image")
TEXT_OUTPUT = ("text", "json", "structured", "structured-output", "structured_output")
#: Patterns of model names.
OCR_NAMES = (r"\bocr\b", "paddleocr", "mineru")
NO_VISION_NAMES = ("codex", r"\btts\b", "transcrib", r"\basr\b", r"\bspeech\b", r"\bvoice\b", r"\baudio\b", "whisper", "embedding", "embed", "rerank", "re-rank", "moderation", "safety", "realtime")
DRAWING_NAMES = (r"\bdall-e\b", r"\bsora\b", "gpt-image", "glm-image", "qwen-image", "image-generation", "image-edit")
VISION_NAMES = (
    r"^gpt-(?:4o|4\.1|5)",
    r"^o[134](?:[-.].*)?$",
    "^claude-(?:3|opus-4|sonnet-4|haiku-4)",
    "^gemini",
    "^qvq-",
    r"qwen(?:2|2\.5|3)?-vl",
    r"\bglm-\d+(?:\.\d+)?v(?:[-.].*)?$",
    "deepseek[-_]?ocr",
    "paddleocr[-_]?vl",
    "glm[-_]?ocr",
    "olmocr",
    "mineru",
    "internvl",
    "pixtral",
    "llava",
    "minicpm[-_]?v",
    "kimi.*vl",
    "(?:doubao|seed|step|hunyuan).*(?:vision|vl)",
)


def canonical(setting: str, value: Column) -> Column:
    """The value in lower case under its one name; blank, and where only some values may be, any other is the default."""
    default, names, allowed = SETTINGS[setting]
    given = F.coalesce(F.lower(cleaned(value)), F.lit(default))
    out = given if allowed is None else F.when(given.isin(*allowed), given).otherwise(default)
    for name, others in names.items():
        out = F.when(given.isin(*others), name).otherwise(out)
    return out


def model_name(model: Column) -> Column:
    """Lower case, with single hyphens for all but letters, digits, dots, pluses and hyphens."""
    plain = F.regexp_replace(F.lower(F.coalesce(model, F.lit(""))), r"[^a-z0-9.+-]+", "-")
    return F.regexp_replace(F.regexp_replace(plain, "-{2,}", "-"), "^-+|-+$", "")


def sees(model: Column, inputs: Column, outputs: Column) -> Column:
    """Whether a model reads images: by its listed inputs and outputs (null: none) if images are among the inputs, else by its name."""
    none = F.array().cast("array<string>")
    taken, given = F.coalesce(inputs, none), F.coalesce(outputs, none)
    structured = F.when(F.arrays_overlap(taken, F.array(*map(F.lit, IMAGE_INPUT))), (F.size(given) == 0) | F.arrays_overlap(given, F.array(*map(F.lit, TEXT_OUTPUT))))
    name = model_name(model)
    return F.coalesce(structured, name.rlike("|".join(VISION_NAMES)) & ~name.rlike("|".join(NO_VISION_NAMES + DRAWING_NAMES)))


def has_capability(model: Column, inputs: Column, outputs: Column, capability: Column) -> Column:
    """``vision`` and ``ocr`` are judged, any other capability is had by all models."""
    reads = F.lower(F.coalesce(model, F.lit(""))).rlike("(?U)" + "|".join(OCR_NAMES))
    return F.when(capability == "vision", sees(model, inputs, outputs)).when(capability == "ocr", reads).otherwise(True)

#: Of each provider the route, whether it is a vision-language model (None: by the model's name), and whether
#: the main client may be used again, texts and line breaks may be refined, breaks are refined unasked (None: for such models), and never.
ROUTES: dict[str, tuple[str, bool | None, bool, bool, bool, bool | None, bool]] = {
    "baidu": ("machine_ocr", False, False, False, False, False, True),
    "paddle_local": ("machine_ocr", False, True, True, True, False, False),
    "local": ("machine_ocr", False, True, True, True, False, False),
    "tesseract": ("machine_ocr", False, True, True, True, False, False),
    "paddle": ("remote_doc_parser", True, False, False, True, True, False),
    "aiocr": ("remote_prompt_ocr", None, False, False, True, True, False),
    "auto": ("hybrid_auto", None, True, True, True, None, False),
}
UNKNOWN_ROUTE = ("unknown", None, True, False, False, False, False)
#: Routes of the one provider for which the chain decides.
CHAIN_PROVIDER, CHAIN_ROUTES = "aiocr", {"doc_parser": "remote_doc_parser", "layout_block": "local_layout_block_ocr"}
ROUTE_FLAGS = ("vision_model", "reuse", "refine_text", "refine_breaks", "auto_breaks", "no_breaks")


def route_plan(provider: Column, model: Column, chain: Column) -> Column:
    """``kind`` and the flags of ROUTE_FLAGS for a provider, by the model's name and the chain (null: none)."""
    by_name = F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit("paddleocr-vl"))

    def plan(row: tuple) -> Column:
        return F.struct(F.lit(row[0]).alias("kind"), *((by_name if v is None else F.lit(v)).alias(n) for n, v in zip(ROUTE_FLAGS, row[1:])))

    out = plan(UNKNOWN_ROUTE)
    for name, row in ROUTES.items():
        out = F.when(provider == name, plan(row)).otherwise(out)
    asked = F.lower(F.trim(chain))
    for name, kind in CHAIN_ROUTES.items():
        out = F.when((provider == CHAIN_PROVIDER) & (asked == name), plan((kind, *ROUTES[CHAIN_PROVIDER][1:]))).otherwise(out)
    return out
