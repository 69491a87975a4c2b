"""Texts, bounds and seeds that reports and comparisons depend on."""

# -- drop reasons; stable strings, renaming one breaks comparisons between reports --
UNPARSED_NAME = "filename did not parse"
NO_PARTS = "no word files for the line"
EMPTY_TEXT = "empty transcription"
OUT_OF_CHARSET = "characters outside charset"
INCOMPLETE = "word indices have gaps -- untranscribed ink"
BAD_SEGMENTATION = "line segmentation marked err"
MISSING_IMAGE = "image file missing"

# -- scope exclusions; counted apart from the drops --
EXCLUDED_GROUP = "excluded writer"
EXCLUDED_TEXT = "excluded passage"

DEFAULT_EXCLUDED_WRITERS = ("0431",)
DEFAULT_EXCLUDED_TEXTS = ("6",)

# -- component reject reasons --

# -- alphabets, in index order; index 0 pads, index 1 stands for anything else --
PAD_INDEX = 0
UNK_INDEX = 1
FIRST_INDEX = 2
REPLACEMENT = "�"
PUNCTUATION = " !\"#&'()*+,-./:;?"
DIGITS = "0123456789"
UPPERCASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERCASE = "abcdefghijklmnopqrstuvwxyz"

# -- seeds and resampling --
SEED = 1337
RESAMPLES = 2000
FRECHET_RESAMPLES = 100
CONFIDENCE = 0.95

# -- selection gates --
CANDIDATES = 4
EXTRA_DRAWS = 4
ACCEPT_SCORE = 0.5
ACCEPT_OVERRUN = 2
OMISSION_SUPPORT = 10.0
WIDTH_BAND = (0.70, 1.40)
STYLE_RANGE = (500.0, 1100.0)
ORDERINGS = ("width", "letters")

# -- length budget --
UNITS_PER_CHAR = 5.5
MIN_UNITS = 32
MAX_UNITS = 384

# -- verdicts and floors --
BLIND_PASS = 0.60
MIN_GROUPS_FOR_VERDICT = 10
GAIN_NEEDED = -0.03
WIDTH_TOLERANCE = 0.15
TOO_WIDE = 1.15
TOO_NARROW = 0.87
PREFLIGHT_NARROW = 0.3
SELF_FRECHET_LIMIT = 0.5
RETRIEVAL_FLOOR = 0.30
ERROR_CEILING = 0.25
FRECHET_MIN_ROWS = 50
CHANCE_MULTIPLE = 3.0
CARRIED_SHARE = 0.5
PENALTY = 1.0
FOLDS = 10

# -- sampling depths --
REFERENCE_DEPTH = 12
REFERENCE_MINIMUM = 6
CAP_PER_GROUP = 120
FILTERED_LIMIT = 400

# -- tone --
INK_PERCENTILE = 0.02
PAPER_PERCENTILE = 0.85
TONE_QUANTILES = 21

# -- peaks --
LINE_MIN_SHARE = 0.08
STRAY_SHARE = 0.75

# -- stop rule --
MAX_CONSECUTIVE_FAILURES = 3

# -- packs --
PACK_VERSION = 1

# -- baselines --
REQUIRED_METRICS = ("fid_floor", "cer_real", "retrieval_real")

# -- name patterns --
PAGE_NAME = r"(?i)^(\d{4})-(\d+)(?:-cropped)?\.(?:tif|tiff|png|jpg)$"
PART_NAME = r"^(\d{4,})-(\d+)-(\d+)-(\d+)-(.+)$"
LINE_NAME = r"^(\d{4,})-(\d+)-(\d+)$"
IMAGE_SUFFIX = r"(?i)\.(?:tif|tiff|png|jpg)$"
CODE_PREFIX = "ANSWERS"


# What ends a line, and what counts as white space.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]"
