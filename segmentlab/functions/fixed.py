"""Fixed values. They must equal the published behaviour for results to agree,
so they are kept here as plain text."""

# Media files that are accepted.
MEDIA_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "webm"]
MP4_BOX_TYPES = ["ftyp", "moov", "mdat", "wide", "free", "skip"]
EBML_MAGIC = "1A45DFA3"
MAX_MEDIA_BYTES = 500 * 1024 * 1024

# Job states, stages in their order, stages each gate looks at.
ACTIVE_STATUSES = ["PROCESSING", "AWAITING_REVIEW", "PROCESSING_PHASE2"]
RUNNING_STATUSES = ["PROCESSING", "PROCESSING_PHASE2"]
STAGES = ["audio_separate", "video_ocr", "transcribe", "translate", "synthesize", "lip_sync", "mux"]
PHASE1_REQUIRED = ["audio_separate", "transcribe", "translate"]
OPTIONAL_PHASE2 = ["lip_sync"]
TIMEOUT_ERROR = "Job timed out"

# Language name -> code.
LANGUAGE_CODES = {
    "tiếng việt": "vi", "vietnamese": "vi", "vi": "vi",
    "english": "en", "en": "en",
    "日本語": "ja", "japanese": "ja", "ja": "ja",
    "中文": "zh", "chinese": "zh", "zh": "zh",
    "한국어": "ko", "korean": "ko", "ko": "ko",
    "français": "fr", "french": "fr", "fr": "fr",
    "deutsch": "de", "german": "de", "de": "de",
}
VIETNAMESE_PREFIX = "tiếng việt"
VIETNAMESE_NAMES = ["vi", "vietnamese"]

# CJK radicals, symbols, kana, bopomofo, jamo, ideographs, Yi,
# Hangul, compatibility and full-width forms, as code point ranges. The last
# wide one (8C48 to FAFF) is the published range, private use area included.
WRONG_SCRIPT_RANGES = [
    (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303F),
    (0x3040, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7AF), (0x8C48, 0xFAFF),
    (0xFE30, 0xFE4F), (0xFF00, 0xFFEF),
]

# Spoken Vietnamese.
VI_DIGITS = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
VI_SCALES = ["", " nghìn", " triệu", " tỷ", " nghìn tỷ", " triệu tỷ"]
VI_HUNDRED, VI_TEN, VI_TENS, VI_GAP, VI_POINT = "trăm", "mười", "mươi", "lẻ", "phẩy"
VI_UNIT_AFTER_TEN = {5: "lăm"}
VI_UNIT_AFTER_TENS = {1: "mốt", 4: "tư", 5: "lăm"}
VI_MAX_DIGITS = 18
VI_LETTERS = {
    "A": "a", "B": "bê", "C": "xê", "D": "đê", "E": "e", "F": "ép", "G": "gờ",
    "H": "hắt", "I": "i", "J": "gi", "K": "ca", "L": "lờ", "M": "mờ", "N": "nờ",
    "O": "ô", "P": "pê", "Q": "quy", "R": "rờ", "S": "ét", "T": "tê", "U": "u",
    "V": "vê", "W": "vê kép", "X": "ích", "Y": "i", "Z": "dét",
}

# Spoken English.
EN_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
EN_TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
            "seventeen", "eighteen", "nineteen"]
EN_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
EN_SCALES = ["", " thousand", " million", " billion", " trillion", " quadrillion",
             " quintillion", " sextillion", " septillion", " octillion", " nonillion", " decillion"]

# Limits and rates of the transcript and voice steps.
MAX_GAP = 0.8
WORDS_PER_SECOND = 5.5
MIN_WORDS = 2
CHUNK_SIZE = 20
CONTEXT_LINES = 5
NO_SPEAKER = "UNKNOWN"
NO_CONTEXT = "None"
STYLE_KEY_CHARS = 24
REFERENCE_CAP = 10.0
MIN_OWN_REFERENCE = 1.5
MIN_RATE, MAX_RATE = 0.4, 2.5

# Limits of the detection steps.
GRID = 20
BOX_PAD = 10
STATIC_SHARE = 0.7
STATIC_SAMPLES, DYNAMIC_SAMPLES, MEDIAN_SAMPLES = 30, 8, 20
ROW_DIVISIONS, MIN_ROW_HEIGHT = 26, 40
PERSIST_SHARE, PERSIST_FRAMES = 0.12, 3
MAX_BOX_SHARE, MAX_AREA_SHARE = 0.35, 0.45
EVEN_PAD, MIN_SIDE, MAX_RADIUS = 6, 8, 22
WINDOW_GAP = 0.1
MAX_REGIONS = 40
MIN_SCORE = 0.7

# Quality limits.
SILENCE_RMS = 0.001
MAX_STRETCH = 1.5

# Columns of the voice catalogue that are public.
PUBLIC_VOICE_FIELDS = ["id", "name", "country", "flag", "lang", "gender"]

# Words read out for signs, and time words that are not said twice.
VI_DONG, VI_PLUS, VI_EQUALS, VI_PERCENT, VI_DOLLARS, VI_AND = "đồng", "cộng", "bằng", "phần trăm", "đô la", "và"
EN_PERCENT, EN_DOLLARS, EN_AND = "percent", "dollars", "and"
VI_TIME_WORDS = ["ngày", "tháng", "năm", "giờ"]

# Settings of a job that a watched folder queues, and the columns that older job tables lack with what they mean there.
WATCH_SETTINGS = {
    "target_lang": "Tiếng Việt", "target_style": "Tiêu chuẩn", "vram_profile": "16gb", "enable_lipsync": False, "enable_ocr": False,
    "ocr_mode": "blur", "voice_mode": "multi", "voice_preset": "", "auto_resume": True,
}
JOB_DEFAULTS = {
    "target_style": "Tiêu chuẩn", "enable_lipsync": False, "enable_ocr": True, "ocr_mode": "blur", "auto_resume": False,
    "voice_mode": "multi", "voice_preset": "",
}
