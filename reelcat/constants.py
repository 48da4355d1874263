"""Fixed values that must equal the reference's for results to match.

They are listed here plainly, in their natural order, and every module reads
them from this file.
"""

# --- fixed values: task lifecycle -------------------------------------------
TASK_STATUSES = ["queued", "processing", "completed", "failed"]
TERMINAL_STATUSES = ["completed", "failed"]
# Legal transitions of the task graph: queued -> processing -> completed | queued | failed.
LEGAL_TRANSITIONS = [
    ("queued", "processing"),
    ("processing", "completed"),
    ("processing", "queued"),
    ("processing", "failed"),
]
MAX_RETRIES = 2

# --- fixed values: stage time limits, seconds ---------------------------------
INFO_EXTRACTION_TIMEOUT_S = 300
DOWNLOAD_TIMEOUT_S = 900
UPLOAD_TIMEOUT_S = 600
SOCKET_TIMEOUT_S = 30
OVERALL_TIMEOUT_S = INFO_EXTRACTION_TIMEOUT_S + DOWNLOAD_TIMEOUT_S + UPLOAD_TIMEOUT_S  # 1800
SMALL_FILE_UPLOAD_TIMEOUT_S = 60
URL_GENERATION_TIMEOUT_S = 30
# extra seconds allowed around awaited steps for asynchronous overhead
ASYNC_BUFFER_S = 60
# stage -> seconds allowed from the stage start
STAGE_LIMITS = [
    ("overall", OVERALL_TIMEOUT_S),
    ("direct_processing", DOWNLOAD_TIMEOUT_S + UPLOAD_TIMEOUT_S + ASYNC_BUFFER_S),
    ("download", DOWNLOAD_TIMEOUT_S + ASYNC_BUFFER_S),
    ("video_upload", UPLOAD_TIMEOUT_S),
    ("metadata_upload", SMALL_FILE_UPLOAD_TIMEOUT_S),
    ("thumbnail_upload", SMALL_FILE_UPLOAD_TIMEOUT_S),
    ("url_generation", URL_GENERATION_TIMEOUT_S),
]

# --- fixed values: error codes and retry classes ------------------------------
RETRYABLE_DOWNLOAD_CODES = ["TIMEOUT", "NETWORK_ERROR"]
ERROR_CODES = ["TIMEOUT", "FORMAT_ERROR", "NETWORK_ERROR"]
# provider named in storage error texts
STORAGE_PROVIDER = "supabase"
# error text: message, then labelled parts, joined by the separator
ERROR_TEXT_SEPARATOR = " | "
ERROR_URL_LABEL = "URL: "
ERROR_PROVIDER_LABEL = "Provider: "
ERROR_CODE_LABEL = "Code: "
# failure payload "error" values (timeout, anything else)
FAILURE_TIMEOUT = "Task timed out"
FAILURE_OTHER = "Failed to process video"

# --- fixed values: webhook delivery -------------------------------------------
WEBHOOK_MAX_ATTEMPTS = 3
WEBHOOK_AUTH_MARKER = "supabase.co/functions"

# --- fixed values: object catalogue -------------------------------------------
KEY_ROOT = "videos"
FILE_TYPES = ["video", "metadata", "thumbnail"]
UNKNOWN_FILE_TYPE = "unknown"
METADATA_SUFFIX = ".info.json"
THUMBNAIL_SUFFIXES = [".jpg", ".png", ".webp"]
DEFAULT_THUMBNAIL_EXT = "jpg"
# direct-path file names: {id}_{video id}.mp4, {id}_info.json, {id}_thumbnail.{ext}
DIRECT_VIDEO_EXT = ".mp4"
DIRECT_METADATA_SUFFIX = "_info.json"
DIRECT_THUMBNAIL_INFIX = "_thumbnail."
# public access URL: {base}/storage/v1/object/public/{bucket}/{key}
PUBLIC_URL_PATH = "/storage/v1/object/public/"
# lower-cased extension -> content type
CONTENT_TYPES = [
    (".mp4", "video/mp4"),
    (".avi", "video/x-msvideo"),
    (".mov", "video/quicktime"),
    (".wmv", "video/x-ms-wmv"),
    (".flv", "video/x-flv"),
    (".webm", "video/webm"),
    (".mkv", "video/x-matroska"),
    (".jpg", "image/jpeg"),
    (".jpeg", "image/jpeg"),
    (".png", "image/png"),
    (".gif", "image/gif"),
    (".webp", "image/webp"),
    (".json", "application/json"),
]
LIST_DEFAULT_LIMIT = 100
PAGE_DEFAULT_LIMIT = 20
PAGE_MAX_LIMIT = 100
SUPPORTED_SITES_SHOWN = 100

# --- fixed values: media policy (declared, not enforced by the reference) ------
MAX_FILE_SIZE = 1073741824
ALLOWED_FORMATS = ["mp4", "avi", "mov", "wmv", "flv", "webm", "mkv"]
BEST_FORMAT_MAX_HEIGHT = 720

# --- fixed values: transfer chunks --------------------------------------------
STREAM_CHUNK_BYTES = 8388608
UPLOADER_CHUNK_BYTES = 5242880

# --- fixed values: URL patterns, tried in this order ---------------------------
VIDEO_ID_PATTERNS = [
    r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([a-zA-Z0-9_-]+)",
    r"youtube\.com/v/([a-zA-Z0-9_-]+)",
    r"tiktok\.com/@[^/]+/video/(\d+)",
    r"tiktok\.com/t/([a-zA-Z0-9]+)",
]
DOMAIN_PATTERN = r"://([^/]+)"
DOMAIN_PREFIX_PATTERN = r"^(www\.|m\.)"
URL_SCHEMES = ["http://", "https://"]
YOUTUBE_MARKERS = ["youtube.com", "youtu.be"]

# --- fixed values: result warnings -------------------------------------------
WARNINGS = [
    "direct_processing_failed",
    "url_mismatch",
    "metadata_upload_failed",
    "thumbnail_upload_failed",
    "info_url_generation_failed",
    "thumbnail_url_generation_failed",
    "metadata_creation_failed",
    "thumbnail_processing_failed",
    "metadata_url_generation_failed",
]
# warnings that mark a result as partial (failed uploads only)
PARTIAL_WARNINGS = ["metadata_upload_failed", "thumbnail_upload_failed"]

# --- fixed values: log format ------------------------------------------------
# '%(asctime)s - %(name)s - %(levelname)s - %(message)s'
LOG_LINE_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - ([A-Z]+) - (.*)$"
LOG_TASK_TAG_PATTERN = r"^\[([^\]]+)\]"
LOG_STAGE_PATTERN = r"Stage (\d+):"
# documented log patterns to monitor (name, regular expression)
LOG_WATCH_PATTERNS = [
    ("stage_progress", r"\[[^\]]+\] Stage \d+: "),
    ("proxy_usage", r"Using proxy for request"),
    ("retry_attempt", r"Retrying in \S+ seconds\.\.\."),
    ("timeout", r"Timeout during video processing"),
]
