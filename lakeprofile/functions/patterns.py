"""Patterns shared by all expressions.

Fixed values: they decide which text counts as a number, a line, a tag or a word.
"""

EOL = r"\r\n|\r|\n"
WHITE_SPACE = " \t\n\x0b\f\r"
NUMBER = (
    r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)
FINITE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WORD = r"[a-zA-Z]{3,}"
TAG = r"<[^\r\n]+>"
PLACEHOLDER_NAME = r"^__\d*__"
# Bytes that never occur in text files of any common encoding.
NON_TEXT = r"[\x00-\x06\x0E-\x1A\x1C-\x1F\x7F]"

# Delimiters in the order in which they are tried, with the split pattern of each.
DIALECTS = ((",", ","), ("\t", "\t"), (" ", r"\s"))

# Leading bytes (hexadecimal) and the media type they stand for.
SIGNATURES = (
    ("25504446", "application/pdf"),
    ("504B0304", "application/zip"),
    ("D0CF11E0A1B11AE1", "application/vnd.ms-office"),
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("43444601", "application/x-netcdf"),
    ("43444602", "application/x-netcdf"),
    ("894844460D0A1A0A", "application/x-hdf5"),
    ("50415231", "application/vnd.apache.parquet"),
    ("1F8B", "application/gzip"),
)

FOOTER_LINES = 5
MIN_VALUE_ROWS = 5
PREAMBLE_CHARS = 1000
DIGIT_SAMPLE_CHARS = 1000
PROSE_DIGIT_SHARE = 0.2
SENTINEL_EPSILON = 1.0
MIN_TOPIC_WEIGHT = 0.01
NEIGHBOURS = 9
