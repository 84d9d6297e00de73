"""Fixed values the operators depend on."""

# Strings a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Column names recognised as the text column, compared in lower case.
TEXT_COLUMN_NAMES = ["reviews", "review", "text", "comment", "feedback", "description"]

# Facet columns, first candidate present wins (exact case).
FACET_CANDIDATES = {
    "drug": ["Drug", "drug", "drugName", "drug_name"],
    "age": ["Age", "age"],
    "satisfaction": ["Satisfaction", "satisfaction"],
    "gender": ["Gender", "gender", "Sex", "sex"],
}

# Labels of the outlier class and of unnamed topics.
OUTLIER_ID = -1
OUTLIER_NAME = "Outliers/Miscellaneous"
FALLBACK_NAME_PREFIX = "Topic "

# Limits of the topic report.
MIN_ROWS_TO_MODEL = 10
SMALL_DATASET_ROWS = 50
DEFAULT_TOPICS = 5
DEFAULT_MIN_TOPIC_SIZE = 10
KEYWORDS_IN_NAME = 4
KEYWORDS_IN_PROMPT = 6
KEYWORDS_IN_DETAIL = 10
SAMPLES_IN_DETAIL = 5
SAMPLES_IN_SUMMARY = 3
PREVIEW_CHARS = 100
ENCODE_BATCH = 100

# A short list of English function words. Any other list can be passed to the operators,
# for instance StopWordsRemover.loadDefaultStopWords("english").
ENGLISH_STOP_WORDS = [
    "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "him", "his", "how", "if", "in", "into", "is", "it", "its", "just",
    "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your",
]
