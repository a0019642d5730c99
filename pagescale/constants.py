"""Fixed values that results depend on. They are settings of the published measurements, stated as plain data."""

# Mean glyph width and line height in pixels per font size.
FONT_METRICS = {20: (10.0369, 19.0), 28: (14.0533, 26.0), 36: (18.0624, 33.0)}

# The measured style grid and the rendered square sizes.
FONT_SIZES = [20, 28, 36]
LINE_SPACINGS = [0, 6, 24, 42]
LETTER_SPACINGS = [-1, 0, 7]
RESOLUTIONS = [512, 640, 1024, 1280]
STYLE_KEYS = ["font_size", "line_spacing", "letter_spacing"]
GROUP_KEYS = ["resolution", *STYLE_KEYS]
BASE_STYLE = (28, 6, 0)

# Named density presets (font size, line spacing, letter spacing).
DENSITY_GROUPS = {"GroupA": (28, 6, 0), "GroupB": (28, 2, -1), "GroupC": (28, 12, 6)}

# Interval detection and clean-up.
BIN_WIDTH = 100
Q_HIGH = 0.9
Q_LOW = 0.1
LEFT_THRESHOLD = 0.1
RIGHT_THRESHOLD = 0.3
REARM_THRESHOLD = 0.15
MIN_INTERVAL_POINTS = 10
FILTER_SCALE = {1024: 0.2, 1280: 0.1}
FILTER_SCALE_DEFAULT = 0.4
DROP_TOP = {512: 5, 640: 10, 1024: 15, 1280: 20}
ERROR_CAP = {512: 0.4, 640: 0.4, 1024: 0.2, 1280: 0.2}

# Log-log fits.
LOG_ERROR_MIN = -6.0
MIN_LOG_LENGTH = {1280: 9.15}
TRIM_FRACTION = {512: 0.05, 640: 0.05, 1024: 0.10, 1280: 0.15}
TRIM_NEIGHBOURS = 10
CONSENSUS_RESOLUTIONS = (1280,)
CONSENSUS_RESIDUAL = 0.05
CONSENSUS_SHARE = 0.9
CONSENSUS_TRIALS = 300

# Zone breaks of the length axis and the hard-wall length per resolution.
ZONE_BREAKS = {512: (3500, 7000), 640: (5600, 10100), 1024: (9500, 20300), 1280: (8600, 21000)}
HARD_WALL = {640: 11000, 1024: 19150}

# Collapse-model defaults.
EM_THRESHOLD = 0.37
EM_SOFT = 0.05
EM_TOL = 1e-6
EM_MAX_ITER = 200
EM_EPS = 1e-6
BETA_MIN = 1e-3
BETA_MAX = 1e4
CURVE_Z = (-2.0, 3.4)
MODEL_VISION_TOKENS = {"model_a": 324.0, "model_b": 1280.0}

# Tile modes (base side, tile side, tiles on).
PAGE_MODES = {
    "tiny": (512, 512, False),
    "small": (640, 640, False),
    "base": (1024, 1024, False),
    "large": (1280, 1280, False),
    "tiled": (1024, 640, True),
}
MIN_TILES = 2
MAX_TILES = 6

# Markers of the book formats and of recognised output.
CHAPTER_MARKER = r"^\s*CHAPTER\s+([A-Z0-9]+)[^\r\n]*"
NUMBERED_MARKER = r"(?i)^\s*Chapter\s+(\d+)\s*:[^\r\n]*"
HEADED_MARKER = r"CHAPTER\s+([IVXLCDM]+|\d+)\."
LETTER_START = r"_Dear\s+Pierrepont:_"
LETTER_END = ("your affectionate father,", "john graham.")
SECTIONS_SKIPPED = 3
GROUNDING_TAG = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
IMAGE_TAG = r"(?s)<\|ref\|>image<\|/ref\|><\|det\|>.*?<\|/det\|>"
END_TOKEN = "<｜end▁of▁sentence｜>"
PAGE_BREAK = "\n<--- Page Split --->"

# Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# Markdown images and links, marks at the start of a line, and code fences.
MD_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
MD_LINK = r"\[([^\]]+)\]\([^)]+\)"
MD_MARKS = r"^[#>*\-\d.)(]+\s*"
FENCE_START = r"\A```[a-zA-Z]*\n"
FENCE_END = r"\n```\z"

# White space at the ends, runs of it, line ends, and the gap after a sentence.
EDGE_SPACE = r"(?U)\A\s+|\s+\z"
SPACES = r"(?U)\s+"
LINE_END = r"\r\n|\n|\r"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
