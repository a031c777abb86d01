"""Fixed values.

These lists, names, formats and limits are part of the behaviour: results are
only right when they hold exactly these values.  Lists, names and limits are
defaults of the operators' parameters, so a caller may pass others; the
messages and the parts of a confidence are used as they are here.
"""

# --- fixed values: code points Python's str.strip() and str.split() treat as space
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]

# --- fixed values: how names of providers are shown
DISPLAY_NAMES = {"xai": "xAI"}
UNKNOWN_PROVIDER = "Unknown"
UNKNOWN_PROVIDER_WEB = "Other"

# --- fixed values: words that mark a catalogue entry as not meant for text
NON_TEXT_KEYWORDS = [
    "image", "vision", "dalle", "dall-e", "clip", "vit", "img", "visual", "pic", "photo",
    "sora", "robot",
    "babbage", "davinci",
    "audio", "tts", "whisper", "speech", "voice", "sound", "music", "orpheus",
    "arabic", "allam",
    "video", "vid", "motion", "animation",
    "embed", "embedding", "similarity", "vector", "retrieval",
    "code", "programming", "dev", "developer",
    "moderation", "safety", "content-filter", "toxic",
    "fine-tune", "finetune", "training", "custom",
    "math", "science", "research",
    "guard", "guardian", "safety-model",
    "edit", "davinci-edit", "curie-edit",
    "realtime", "real-time", "search", "transcribe", "transcription",
]

# --- fixed values: extra exclusions that hold for one provider only
PROVIDER_EXCLUSIONS = {
    "openai": ["davinci-edit", "curie-edit", "babbage-edit", "ada-edit", "o1-pro"],
    "google": ["bison", "gecko", "otter", "unicorn", "computer-use"],
    "anthropic": [],
    "xai": [],
}

# --- fixed values: what a listed entry must contain, and what it may not start with
REQUIRED_SUBSTRING = {"anthropic": "claude", "google": "gemini"}
RETIRED_PREFIXES = {"google": ["gemini-1.0-", "gemini-1.5-", "gemini-2.0-"]}
REQUIRED_ACTION = {"google": "generateContent"}

# --- fixed values: providers whose ids come as paths, and whose entries show a name
PATH_PROVIDERS = ["google"]
NAMED_PROVIDERS = ["anthropic"]

# --- fixed values: dated snapshot suffix, -YYYY-MM-DD or -DDDD in any script's digits,
# --- then optionally -word, at the end or before a last newline
DATE_SUFFIX = r"-(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|\p{Nd}{4})(?:-[a-z]+)?\n?\z"

# --- fixed values: catalogue used when a provider cannot be listed (provider, id, name)
FALLBACK_CATALOGUE = [
    ("openai", "gpt-4o", None),
    ("openai", "gpt-4o-mini", None),
    ("openai", "gpt-4-turbo", None),
    ("openai", "gpt-3.5-turbo", None),
    ("anthropic", "claude-3-5-sonnet-20241022", "Claude Sonnet 3.5"),
    ("anthropic", "claude-3-7-sonnet-20250219", "Claude Sonnet 3.7"),
    ("anthropic", "claude-sonnet-4-20250514", "Claude Sonnet 4"),
    ("anthropic", "claude-opus-4-20250514", "Claude Opus 4"),
    ("anthropic", "claude-3-5-haiku-20241022", "Claude Haiku 3.5"),
    ("google", "gemini-3.5-flash", None),
    ("google", "gemini-3.1-flash-lite", None),
    ("google", "gemini-3.1-pro-preview", None),
    ("google", "gemini-2.5-flash", None),
    ("google", "gemini-2.5-pro", None),
    ("xai", "grok-4-0709", None),
    ("xai", "grok-3", None),
    ("xai", "grok-3-mini", None),
]

# --- fixed values: tasks (key, id, name)
TASKS = [
    ("1", "refine", "Refine Text (Email, Article, etc.)"),
    ("2", "refine_presentation", "Refine Presentation (Summarize Article)"),
    ("3", "auto_translate", "Auto-Translate (Detect Language & Translate)"),
]
AUTO_TRANSLATE = "auto_translate"

# --- fixed values: language -> (source shown, target shown, task id)
ROUTES = {
    "zh": ("Chinese", "English", "zh_to_en"),
    "zh-cn": ("Chinese", "English", "zh_to_en"),
    "zh-tw": ("Chinese", "English", "zh_to_en"),
    "en": ("English", "Simplified Chinese", "en_to_zh"),
}
DEFAULT_TARGET = "Refined Text"
DEFAULT_ROUTE_TASK = "refine"
UNKNOWN_LANGUAGE = "unknown"

# --- fixed values: confidence of a detected language
CHINESE_LANGUAGES = ["zh", "zh-cn", "zh-tw"]
CHINESE_CLASS = r"\x{4e00}-\x{9fff}"
COMMON_ENGLISH_WORDS = ["the", "and", "to", "of", "a", "in", "is", "it", "you", "that"]
BASE_CONFIDENCE = 0.7
MAX_LENGTH_BONUS = 0.2
MAX_PATTERN_BONUS = 0.1
LENGTH_DIVISOR = 100
WORDS_DIVISOR = 10

# --- fixed values: limits
TERMINATOR = "done!!!"
SNAPSHOT_TTL_SECONDS = 3600
FAILURE_THRESHOLD = 3
RECOVERY_SECONDS = 60.0
RETRY_ATTEMPTS = 3
RETRY_PAUSE_SECONDS = 2.0
MIN_KEY_LENGTH = 10

# --- fixed values: symbol -> tag, applied in this order
SYMBOL_TAGS = {
    "✅": "[OK]", "❌": "[ERROR]", "⚠️": "[WARN]", "ℹ️": "[INFO]",
    "⏳": "[LOADING]", "🔎": "[FILTER]", "📋": "[CACHE]", "💾": "[SAVE]",
    "📊": "[STATS]", "🔄": "[RETRY]", "⚪": "[SKIP]", "🤖": "[AI]",
    "👋": "[BYE]", "🗑️": "[CLEAR]",
}

# --- fixed values: messages; {…} marks what is filled in
MSG_NO_KEYS = "At least one API key must be provided"
MSG_KEY_EMPTY = "{name} API key is empty"
MSG_KEY_SHORT = "{name} API key appears to be too short"
MSG_CONFIG_FAILED = "Configuration validation failed:"
MSG_NO_CREDENTIAL = "{label} API Key not found."
MSG_INIT_FAILED = "Failed to initialize {key}: {error}"
MSG_MODEL_REQUIRED = "model is required"
MSG_TASK_REQUIRED = "task_key must be one of {keys}"
MSG_TEXT_REQUIRED = "text is required"
MSG_UNKNOWN_MODEL = "Unknown model: {model}"
UNKNOWN_TASK = "unknown"
MSG_NO_MODEL = "No model selected"
MSG_NO_TASK = "No task selected"
MSG_MODEL_NOT_FOUND = "Model '{model}' not found"
MSG_PROMPT_NOT_FOUND = "Prompt for task '{task}' not found"
MSG_BREAKER_OPEN = (
    "Circuit breaker is open for '{key}'. "
    "The model has failed repeatedly and is temporarily unavailable."
)
MSG_PROCESSING = "Processing error in task '{tag}': {message}"
MSG_INIT = "Failed to initialize model '{tag}': {message}"
MSG_API = "API error with {tag}: {message}"
MSG_QUOTA = "Google API quota exceeded. Please wait and try again, or select a different model."
MSG_RATE_LIMIT = (
    "API rate limit or quota exceeded. Please wait and try again, or select a different model."
)
MSG_NO_MODELS = "No AI models were successfully initialized."
MSG_NO_MODELS_ERRORS = "Errors:"
MSG_NO_MODELS_HINT = "Please check your .env file for correct API keys and network connection."
MSG_UNEXPECTED = "An unexpected error occurred: {message}"
