"""Model requests and responses as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import config as cfg


def parse_candidates(body: Column) -> Column:
    """Struct of status (ok, blocked, malformed) and text of a "candidates" response."""
    text = F.get_json_object(body, "$.candidates[0].content.parts[0].text")
    candidates = F.get_json_object(body, "$.candidates")
    feedback = F.get_json_object(body, "$.promptFeedback")
    status = (
        F.when(text.isNotNull(), "ok")
        .when(candidates.isNull() & feedback.isNotNull(), "blocked")
        .otherwise("malformed")
    )
    return F.struct(status.alias("status"), text.alias("text"))


def parse_choices(body: Column) -> Column:
    """Struct of status (ok, no_response, malformed) and text of a "choices" response."""
    text = F.get_json_object(body, "$.choices[0].text")
    status = (
        F.when(body.isNull() | (body == ""), "no_response")
        .when(text.isNotNull(), "ok")
        .otherwise("malformed")
    )
    return F.struct(status.alias("status"), text.alias("text"))


def parse_answer(body: Column, second_backend: bool = False) -> Column:
    """Struct of status and text of the response of either backend."""
    return parse_candidates(body) if second_backend else parse_choices(body)


def affirmative(text: Column) -> Column:
    """A verdict is a yes when it holds the letter y anywhere."""
    return F.contains(F.lower(text), F.lit("y"))


def extract_token(raw: Column) -> Column:
    """Text of one token message; null when either marker is missing."""
    found = F.regexp_extract(raw, '(?s)"response":"(.*?)","', 1)
    token = F.replace(
        F.replace(found, F.lit("\\r"), F.lit("")), F.lit("\\n"), F.lit("\n")
    )
    return F.when(raw.rlike('(?s)"response":".*?","'), token)


def image_list(body: Column) -> Column:
    """Array of the base64 images of a picture response."""
    return F.from_json(body, "images ARRAY<STRING>")["images"]


def decode_image(encoded: Column) -> Column:
    """Bytes of a base64 image, with or without a "data:...," prefix."""
    comma = F.instr(encoded, ",")
    return F.unbase64(F.substring(encoded, comma + 1, F.length(encoded)))


def encode_image(content: Column) -> Column:
    """Base64 text on a single line (Spark breaks it into lines of 76)."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def _literal(value) -> Column:
    if isinstance(value, tuple):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _document(first: dict[str, Column], constants: dict) -> Column:
    fields = [c.alias(k) for k, c in first.items()]
    fields += [_literal(v).alias(k) for k, v in constants.items()]
    return F.to_json(F.struct(*fields))


def completion_request(prompt: Column, max_tokens: Column | int) -> Column:
    """Request document for a completion server."""
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return _document({"prompt": prompt, "max_tokens": limit}, cfg.COMPLETION_CONSTANTS)


def content_request(prompt: Column, verdict: bool = False) -> Column:
    """Request document for the second backend (nested contents and safety settings)."""
    if verdict:
        generation = F.struct(
            F.lit(0.1).alias("temperature"), F.lit(cfg.TOKEN_LIMITS["verdict"]).alias("max_output_tokens")
        )
    else:
        generation = F.struct(
            F.lit(1).alias("temperature"),
            F.lit(cfg.TOKEN_LIMITS["second_backend"]).alias("max_output_tokens"),
            _literal(cfg.SECOND_BACKEND_STOP_STRINGS).alias("stop_sequences"),
        )
    safety = [
        F.struct(F.lit(category).alias("category"), F.lit(strict if verdict else usual).alias("threshold"))
        for category, usual, strict in cfg.SAFETY_SETTINGS
    ]
    part = F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))
    return F.to_json(
        F.struct(
            F.array(part).alias("contents"),
            generation.alias("generation_config"),
            F.array(*safety).alias("safety_settings"),
        )
    )


def token_request(prompt: Column) -> Column:
    """Request document for the token server."""
    fields = [_literal(v).alias(k) for k, v in cfg.TOKEN_BACKEND_CONSTANTS.items()]
    return F.to_json(F.struct(*fields, prompt.alias("prompt")))


def picture_server_request(plan: Column, image: Column) -> Column:
    """Request document for a picture server, from a ``picture_plan``.

    ``image`` is the first attached picture as base64 text; a plan that starts from
    a picture has no document without it.  Unknown sizes of a picture are left out.
    """
    common = [plan[k].alias(k) for k in ("prompt", "negative_prompt", "steps", "width", "height", "sampler_name", "denoising_strength")]
    plain = F.struct(
        *common,
        plan["hr_resize_x"].alias("hr_resize_x"),
        plan["hr_resize_y"].alias("hr_resize_y"),
        *[_literal(v).alias(k) for k, v in cfg.TXT2IMG_CONSTANTS.items()],
        F.create_map().cast("map<string,string>").alias("override_settings"),
    )
    from_picture = F.struct(
        F.array(image).alias("init_images"), *common, *[_literal(v).alias(k) for k, v in cfg.IMG2IMG_CONSTANTS.items()]
    )
    return F.when(plan["endpoint"] == "txt2img", F.to_json(plain)).when(image.isNotNull(), F.to_json(from_picture))
