"""Fixed values, which must equal those users of such tools rely on."""

# Output sizes by name (width, height).
SIZES = {
    "ig-post": (1080, 1080),
    "ig-portrait": (1080, 1350),
    "ig-landscape": (1080, 566),
    "ig-story": (1080, 1920),
    "ig-reel": (1080, 1920),
    "fb-post": (1200, 630),
    "fb-cover": (820, 312),
    "x-post": (1200, 675),
    "x-header": (1500, 500),
    "yt-thumb": (1280, 720),
    "li-post": (1200, 627),
    "li-cover": (1584, 396),
    "4x6": (1800, 1200),
    "5x7": (2100, 1500),
    "8x10": (3000, 2400),
}

# Resampling filters, canonical name -> spellings.
FILTERS = {
    "lanczos": ("lanczos", "lanczos3"),
    "catmull-rom": ("catmull-rom", "catmullrom", "cubic"),
    "bilinear": ("bilinear", "linear"),
    "mks2021": ("mks2021", "magic", "magickernel", "magic-kernel-sharp-2021"),
}

# Named colours (red, green, blue); all are opaque.
COLOURS = {
    "black": (0, 0, 0),
    "white": (255, 255, 255),
    "red": (255, 0, 0),
    "green": (0, 128, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "cyan": (0, 255, 255),
    "magenta": (255, 0, 255),
    "gray": (128, 128, 128),
    "grey": (128, 128, 128),
    "orange": (255, 165, 0),
    "purple": (128, 0, 128),
    "pink": (255, 192, 203),
    "brown": (165, 42, 42),
    "navy": (0, 0, 128),
    "teal": (0, 128, 128),
    "olive": (128, 128, 0),
    "maroon": (128, 0, 0),
    "silver": (192, 192, 192),
    "lime": (0, 255, 0),
    "aqua": (0, 255, 255),
    "fuchsia": (255, 0, 255),
}

# Content types by file extension; all else is an octet stream.
CONTENT_TYPES = {
    ".html": "text/html; charset=utf-8",
    ".htm": "text/html; charset=utf-8",
    ".css": "text/css; charset=utf-8",
    ".js": "application/javascript",
    ".mjs": "application/javascript",
    ".json": "application/json",
    ".xml": "application/xml",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".avif": "image/avif",
    ".svg": "image/svg+xml",
    ".ico": "image/x-icon",
    ".woff": "font/woff",
    ".woff2": "font/woff2",
    ".ttf": "font/ttf",
    ".otf": "font/otf",
    ".eot": "application/vnd.ms-fontobject",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
    ".txt": "text/plain; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".yaml": "text/yaml; charset=utf-8",
    ".yml": "text/yaml; charset=utf-8",
    ".mp4": "video/mp4",
    ".webm": "video/webm",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".ogg": "audio/ogg",
}
OCTETS = "application/octet-stream"

# Image formats by file extension.
IMAGE_FORMATS = {".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".tif": "tiff", ".tiff": "tiff", ".webp": "webp"}

# Log levels by spelling.
LOG_LEVELS = {"debug": "debug", "info": "info", "warning": "warning", "warn": "warning", "error": "error", "": "error"}

# Stack states that end a wait, and the event states that carry a reason.
DONE = ("CREATE_COMPLETE", "UPDATE_COMPLETE")
FAILED = ("CREATE_FAILED", "ROLLBACK_COMPLETE", "ROLLBACK_FAILED", "UPDATE_ROLLBACK_COMPLETE", "UPDATE_ROLLBACK_FAILED", "DELETE_COMPLETE", "DELETE_FAILED")
FAILED_EVENTS = ("CREATE_FAILED", "UPDATE_FAILED")

# The outputs of a stack.
OUTPUTS = ("BucketName", "DistributionId", "DistributionDomain", "SiteURL")

# Texts that tell errors apart.
NOT_THERE, NO_CHANGE = "does not exist", "No updates are to be performed"

# Fixed value: the letters of random ids.
ID_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
