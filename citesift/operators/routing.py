"""Rule cascades of requests: client, key, provider, status and upstream errors. The first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, js_trim, masked_key
from .documents import document_status, question_status
from .scenario import match

# Shapes of keys, and upstream statuses worth another try.
KEY_SHAPES = (r"^AIza[0-9A-Za-z_-]{30,60}\z", r"^AQ\.[0-9A-Za-z_.-]{20,120}\z")
RETRYABLE = (429, 500, 502, 503, 504)
ATTEMPTS, BASE_DELAY_MS, JITTER_MS = 3, 600, 250


def client_key(forwarded: Column, real_ip: Column) -> Column:
    """The first forwarded address; without the header the real one; else unknown."""
    return F.when(F.coalesce(forwarded, F.lit("")) != "", js_trim(F.get(F.split(forwarded, ","), 0))).otherwise(F.coalesce(real_ip, F.lit("unknown")))


def plausible_key(value: Column) -> Column:
    key = js_trim(value)
    return F.coalesce(~key.rlike(SPACE) & (key.rlike(KEY_SHAPES[0]) | key.rlike(KEY_SHAPES[1])), F.lit(False))


def provider(env: Column, override: Column | None = None) -> Column:
    """The provider that an environment (a map) selects, or null: the caller's own key, a local model, then hosted ones.

    An empty first name of the hosted key hides its other names."""
    get = lambda name: F.try_element_at(env, F.lit(name))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    own = plausible_key(override) if override is not None else F.lit(False)
    google = F.coalesce(get("GEMINI_API_KEY"), get("GOOGLE_API_KEY"), get("GOOGLE_GENERATIVE_AI_API_KEY"))
    return (
        F.when(own, "google").when(there(get("LOCAL_MODEL")) | there(get("LOCAL_BASE_URL")), "local").when(there(google), "google")
        .when(there(get("OPENAI_API_KEY")), "openai").when(there(get("ANTHROPIC_API_KEY")), "anthropic")
    )


def chat_route(allowed: Column, body_ok: Column, question: Column, provider_id: Column, upstream: Column, body_null: Column | None = None) -> Column:
    """status, mode and scenario of a question: limit, form, offline answer, stream, fallback answer, error.

    upstream: null if the stream began, else the error status. body_null: the body is JSON's null, which has no fields to read and ends the request with a 500."""
    gate = question_status(question)
    scenario = match(question)
    null = body_null if body_null is not None else F.lit(False)
    body_ok = body_ok & ~null
    status = F.when(~allowed, 429).when(null, 500).when(~body_ok, 400).when(gate != 200, gate).when(provider_id.isNull() | upstream.isNull() | scenario.isNotNull(), 200).otherwise(upstream)
    passed = allowed & body_ok & (gate == 200)
    mode = F.when(~passed, "error").when(provider_id.isNull(), "offline").when(upstream.isNull(), "stream").when(scenario.isNotNull(), "fallback").otherwise("error")
    return F.struct(status.alias("status"), mode.alias("mode"), F.when(mode.isin("offline", "fallback"), scenario).alias("scenario_id"))


def document_route(allowed: Column, body_ok: Column, text: Column, provider_id: Column, upstream: Column, body_null: Column | None = None) -> Column:
    gate = document_status(text)
    return F.when(~allowed, 429).when(body_null if body_null is not None else F.lit(False), 500).when(~body_ok, 400).when(gate != 200, gate).when(provider_id.isNull(), 503).when(upstream.isNull(), 200).otherwise(upstream)


def upstream_error(kind: Column, status: Column) -> Column:
    """The status passed on: timeouts 504, network errors 502, 429 and 503 as they are, all others 502."""
    return F.when(kind == "timeout", 504).when(kind == "network", 502).when(status.isin(429, 503), status).otherwise(502)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def backoff_ms(attempt: Column, jitter: Column) -> Column:
    """Milliseconds before the next attempt; jitter lies in 0 to 1."""
    return BASE_DELAY_MS * F.pow(F.lit(2), attempt - 1) + jitter * JITTER_MS


def request_body(provider_id: Column, model: Column, system: Column, user: Column, max_tokens: Column) -> Column:
    """The JSON body for each provider's protocol. Keys are never part of it."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    google = F.to_json(F.struct(
        F.struct(F.array(F.struct(system.alias("text"))).alias("parts")).alias("systemInstruction"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(user.alias("text"))).alias("parts"))).alias("contents"),
        F.struct(max_tokens.alias("maxOutputTokens")).alias("generationConfig"),
    ))
    chat = lambda field: F.to_json(F.struct(model.alias("model"), F.lit(True).alias("stream"), max_tokens.alias(field), F.array(message("system", system), message("user", user)).alias("messages")))
    anthropic = F.to_json(F.struct(model.alias("model"), F.lit(True).alias("stream"), max_tokens.alias("max_tokens"), system.alias("system"), F.array(message("user", user)).alias("messages")))
    return F.when(provider_id == "google", google).when(provider_id == "openai", chat("max_completion_tokens")).when(provider_id == "local", chat("max_tokens")).when(provider_id == "anthropic", anthropic)


# The addresses of the hosted protocols, and the headers that carry a key.
GOOGLE_URL = "https://generativelanguage.googleapis.com/v1beta/models/{}:streamGenerateContent?alt=sse"
OPENAI_URL, ANTHROPIC_URL = "https://api.openai.com/v1/chat/completions", "https://api.anthropic.com/v1/messages"
KEY_HEADERS = {"google": "x-goog-api-key", "openai": "authorization", "local": "authorization", "anthropic": "x-api-key"}


def request_target(provider_id: Column, model: Column, base_url: Column, key: Column) -> Column:
    """url, header and its value for each provider's protocol. The key is never part of the URL, and the value shows its ends only."""
    before, after = GOOGLE_URL.split("{}")
    local = F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/chat/completions"))
    url = F.when(provider_id == "google", F.concat(F.lit(before), model, F.lit(after))).when(provider_id == "openai", OPENAI_URL).when(provider_id == "anthropic", ANTHROPIC_URL).when(provider_id == "local", local)
    header = F.coalesce(*(F.when(provider_id == name, header) for name, header in KEY_HEADERS.items()))
    shown = F.when(header == "authorization", F.concat(F.lit("Bearer "), masked_key(key))).otherwise(masked_key(key))
    return F.struct(url.alias("url"), header.alias("header"), F.when(header.isNotNull(), shown).alias("value"))


def json_reply(payload: Column, status: Column) -> Column:
    return F.struct(F.to_json(payload).alias("body"), status.cast("int").alias("status"))


def log_line(detail: Column) -> Column:
    return F.substring(detail, 1, 500)


def language_or_default(code: Column) -> Column:
    from ..sources.registry import LANGUAGES

    return F.when(code.isin(*(x[0] for x in LANGUAGES)), code).otherwise("en")
