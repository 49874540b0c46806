"""Speech and chat tasks, and sound as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import dot

# What a speech task asks, before the sound's own token.
ASKS = {"speech_qa": "", "speech_continuation": "Continue the following text using less than 50 words:\\n\\n", "asr": "Transcribe the following audio into text:\\n\\n"}
SPEECH = "<speech>"
#: Frames of codes a second; share of continuations that are transcribed instead.
FRAMES, TRANSCRIBED = 25, 0.3
MEDIA_TAGS = "(?i)<(?:image|video|audio)>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prefix(codes: Column, unit: Column) -> Column:
    """The first one to five seconds of speech codes, by a number from 0 to 1."""
    return F.slice(codes, F.lit(1), F.floor((unit * 4 + 1) * FRAMES).cast("int"))


def messages(question: Column, rounds: Column, continuation: Column, answer: Column, unit: Column) -> Column:
    """A speech task as messages.

    With ``rounds``, the earlier ones are read from ``question`` (USER: ... ASSISTANT: ... up to the last <USER>:). With
    a ``continuation`` the task is to go on or, for the share TRANSCRIBED of numbers ``unit``, to transcribe.
    """
    before = F.when(F.contains(question, F.lit("<USER>:")), F.regexp_extract(question, r"(?s)^(.*)<USER>:", 1)).otherwise(question)
    turns = F.slice(F.filter(F.split(tx.strip(before), "USER:"), lambda x: x != ""), F.lit(1), F.greatest(rounds - 1, F.lit(0)))
    both = lambda x: F.array(_message("user", tx.strip(F.substring_index(x, "ASSISTANT:", 1))), _message("assistant", tx.strip(F.get(F.split(x, "ASSISTANT:"), F.lit(1)))))
    spoken = rounds.isNull() & continuation.isNotNull()
    kind = F.when(spoken & (unit < TRANSCRIBED), "asr").when(spoken, "speech_continuation").otherwise("speech_qa")
    ask = F.create_map(*(F.lit(x) for k, v in ASKS.items() for x in (k, v + SPEECH)))
    last = F.array(_message("user", F.element_at(ask, kind)), _message("assistant", F.when(kind == "speech_continuation", continuation).otherwise(answer)))
    return F.when(rounds > 1, F.concat(F.flatten(F.transform(turns, both)), last)).otherwise(last)


def generated(query: Column, response: Column, english: Column, other: Column) -> Column:
    """User and assistant messages of a generated response, the user's by the query's language; null if it names media."""
    user = F.when(tx.is_english(query), english).otherwise(other)
    return F.when(~response.rlike(MEDIA_TAGS), F.array(_message("user", user), _message("assistant", response)))


def level(wave: Column) -> Column:
    """The root of the mean square, a little above 0 for silence."""
    return F.sqrt(dot(wave, wave) / F.size(wave) + 1e-8)


def mix(wave: Column, noise: Column, ratio: Column) -> Column:
    """``wave`` with ``noise`` (repeated and cut to its length) at ``ratio`` decibels, scaled down where it would clip."""
    scale = level(wave) / (level(noise) + 1e-8) * F.pow(F.lit(10.0), -ratio / 20)
    mixed = F.transform(wave, lambda x, i: x.cast("double") + scale * F.element_at(noise, (i % F.size(noise) + 1).cast("int")).cast("double"))
    peak = F.array_max(F.transform(mixed, F.abs))
    return F.when(peak > 1.0, F.transform(mixed, lambda x: x / (peak + 1e-8))).otherwise(mixed)


def convolved(wave: Column, response: Column) -> Column:
    """``wave`` as a room of this impulse response (its peak made 1) returns it, cut to its length."""
    peak = F.array_max(F.transform(response, F.abs)) + 1e-8
    at = lambda i: F.aggregate(F.sequence(F.lit(0), F.least(i, F.size(response) - 1)), F.lit(0.0), lambda s, k: s + F.get(wave, i - k).cast("double") * F.get(response, k) / peak)
    return F.transform(wave, lambda x, i: at(i))
