"""Picture requests: recognising them, wording the prompt, choosing the parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.config import ChatConfig
from threadloom.functions import text as tx
from threadloom.operators.moderation import detected_tokens, fuzzy_matches, mask_tokens

# Words that turn a request into a selfie, and their wording.
SELFIE_FORMAT = ", looking into the camera, "
HOLDING_FORMAT = ", holding "
SELFIE_WORDS = (
    "person", "you as", "yourself as", "you cosplaying", "yourself cosplaying",
    " of you", " at you", " in you", " for you", " by you", " and you",
)


def picture_request(text: Column) -> Column:
    """Whether a message asks for a picture (a verb, later a word for a picture)."""
    return tx.remove_newlines(text).rlike("(?id)" + cfg.PICTURE_REQUEST_PATTERN)


def prompt_text_guard(request: Column, prompt: Column) -> Column:
    return (F.length(request) > 4) & (F.length(tx.trim_all(prompt)) > 2)


def picture_intent(request: Column, prompt: Column) -> Column:
    """Struct of the selfie flag and the wording that it brings."""
    said = F.lower(request)

    def has(word: str) -> Column:
        return F.contains(said, F.lit(word))

    guard = prompt_text_guard(request, prompt)
    asks = F.lit(False)
    for word in ("selfie", *SELFIE_WORDS, "holding"):
        asks = asks | has(word)
    wording = F.concat(
        F.when(has("selfie"), SELFIE_FORMAT).otherwise(""),
        F.when(has("holding"), HOLDING_FORMAT).otherwise(""),
    )
    return F.struct(
        (guard & asks).alias("selfie"), F.when(guard, wording).otherwise("").alias("format")
    )


def picture_plan(
    selfie: Column, wording: Column, prompt: Column, n_attachments: Column, attached_width: Column,
    attached_height: Column, character: str = cfg.PICTURE_CHARACTER,
) -> Column:
    """Struct of everything a picture server is told."""
    has_image = n_attachments > 0
    portrait = selfie & ~has_image
    width = F.when(portrait, 688).otherwise(768)
    height = F.when(portrait, 768).otherwise(488)
    words = F.when(F.length(prompt) > 0, F.concat(F.lit("(("), prompt, F.lit("))"))).otherwise("")
    full = F.concat(F.when(portrait, character).otherwise(""), wording, F.lit(" "), words)
    return F.struct(
        F.when(has_image, "img2img").otherwise("txt2img").alias("endpoint"),
        full.alias("prompt"),
        F.lit(cfg.PICTURE_NEGATIVE).alias("negative_prompt"),
        F.lit(20).alias("steps"),
        F.when(has_image, attached_width).otherwise(width).alias("width"),
        F.when(has_image, attached_height).otherwise(height).alias("height"),
        F.when(has_image, "DPM++ SDE Karras").otherwise("DDIM").alias("sampler_name"),
        F.when(has_image, 0.35).otherwise(0.3).alias("denoising_strength"),
        F.when(~has_image, width * 2).alias("hr_resize_x"),
        F.when(~has_image, height * 2).alias("hr_resize_y"),
    )


def image_description_line(wording: Column, prompt: Column, bot_name: str) -> Column:
    return F.concat(
        F.lit(f"\n[System]: {bot_name} attached an image: {bot_name}, "),
        wording,
        F.replace(prompt, F.lit("\n"), F.lit(", ")),
        F.lit("\n"),
    )


def raw_picture_prompt(content: Column, quoted: Column) -> Column:
    """Instruction, request (with the replied-to text before it) and header; no tags."""
    request = F.concat(F.coalesce(F.concat(quoted, F.lit("\n")), F.lit("")), content)
    body = tx.trim_all(F.concat(F.lit("### User request: "), request, F.lit("\n" + cfg.PICTURE_HEADER)))
    return F.concat(F.lit(cfg.PICTURE_INSTRUCTION + "\n"), tx.strip_tags(body))


def clean_picture_prompt(prompt: Column, conf: ChatConfig) -> Column:
    """Banned words of all three lists and the bot's name taken out."""
    tokens = detected_tokens(fuzzy_matches(prompt, conf.fuzzy_words))
    out = mask_tokens(prompt, tokens, "")
    out = tx.mask_words(out, conf.exact_words, "")
    out = tx.mask_words(out, conf.exact_picture_words, "")
    return tx.strip_bot_callouts(out, conf.bot_name)


def picture_prompt(content: Column, quoted: Column, conf: ChatConfig) -> Column:
    return clean_picture_prompt(raw_picture_prompt(content, quoted), conf)
