"""Fixed values and defaults; all are parameters of the functions that use them."""

# fixed values: words that keyword search leaves out
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or",
    "the", "that", "this", "to", "was", "what", "with",
)

# fixed values: words that are no evidence of a topic
EVIDENCE_STOPWORDS = (
    "which", "what", "where", "when", "how", "who", "book", "books", "is", "are", "was", "were", "am", "best",
    "good", "for", "of", "the", "a", "an", "recommend", "recommends", "recommended", "covers", "cover", "most",
    "my", "our", "i", "do", "does", "use", "should", "me", "to", "in", "on", "about", "with", "and", "or",
)

# fixed values: course abbreviations
ALIASES = {"dbms": "Database Management System", "dsa": "Data Structures and Algorithms"}

K1, B = 1.5, 0.75
TOP_K, RRF_K, RRF_WEIGHT, DENSE_WEIGHT = 5, 60, 0.7, 0.3
DIMENSIONS = 384
MAX_CHARS, OVERLAP_CHARS = 1200, 150
CONTEXT_CHARS, CONTEXT_SOURCES = 4000, 8
HISTORY_CHARS, HISTORY_MESSAGES = 2000, 12
TITLE_CHARS = 60
MATCH_THRESHOLD, TOPIC_WEIGHT, SUBTOPIC_WEIGHT = 0.4, 0.85, 0.15
SENSITIVE_WORDS = ("password", "secret", "token", "api_key", "authorization")
