"""Values fixed by the task itself: word lists, enumerations and rule tables.

Nothing here is computed.  Changing an entry changes results, so every list is kept
as plain text in its natural order.
"""

# Task classes that are sampled, the hand-written class, run axes.
SAMPLED_INTENTS = ["debug", "generate", "refactor", "explain", "scaffold", "test", "document"]
COMPOSITE_INTENT = "composite"
CONDITIONS = ["a", "b", "c"]
CONDITION_PAIRS = [("a", "c"), ("a", "b"), ("b", "c")]

# Tools a response may call.
VALID_TOOLS = [
    "read_file",
    "write_file",
    "run_tests",
    "search_codebase",
    "git_diff",
    "lint_code",
    "fetch_docs",
    "execute_shell",
]

# Filler alternatives; the order decides which alternative matches.
FILLERS = [
    "um+", "uh+", "like", "you know", "basically", "okay so", "ok so", "so like",
    "so yeah", "so basically", "you know what", "i mean", "kind of", "kinda",
    "sort of", "right", "alright", "well", "yeah", "yep", "nope", "hmm+", "hm+",
]

# Contractions and what they expand to.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "can't": "cannot", "couldn't": "could not", "shouldn't": "should not",
    "wouldn't": "would not", "won't": "will not", "isn't": "is not",
    "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
    "i'm": "I am", "i've": "I have", "i'll": "I will", "i'd": "I would",
    "it's": "it is", "it'll": "it will", "that's": "that is",
    "there's": "there is", "they're": "they are", "they've": "they have",
    "they'll": "they will", "we're": "we are", "we've": "we have",
    "we'll": "we will", "you're": "you are", "you've": "you have",
    "you'll": "you will", "let's": "let us", "what's": "what is",
    "who's": "who is", "how's": "how is", "where's": "where is",
}

# Languages accepted on an opening code fence.
FENCE_LANGUAGES = ["python", "javascript", "js", "bash", "sh", "sql"]

# Prompt labels per condition.
PLAIN_LABEL = "Developer request:"
STRUCTURED_LABEL = "Structured developer request (JSON):"

# Significance level, size of the test family, error text limit,
# response limit of the fidelity judge prompt.
ALPHA = 0.05
FAMILY_SIZE = 12
ERROR_TEXT_LIMIT = 500
JUDGE_RESPONSE_LIMIT = 1500

# Rule checks per task.  Each task lists its clauses; a clause holds when
# any of its substrings occurs.  Clauses starting with CASE keep upper/lower case.
CASE = "\u0001case"
RULES = {
    "debug_001": [["retry", "backoff", "sleep", "delay"], ["try", "except", "catch"]],
    "debug_002": [
        [CASE, "pandas", "pd"],
        [CASE, "merge"],
        [CASE, "column", "key", "if", "try", "except", "validation", "intersection"],
    ],
    "debug_003": [["null"], ["if"], ["login", "user", "username", "password"]],
    "debug_006": [["close", "finally", "cleanup", "with", "try"]],
    "generate_001": [["react"], ["dropdown"], ["usestate", "state", "toggle", "click", "open", "active"]],
    "generate_002": [["jwt", "token", "payload", "decode"], ["middleware", "request", "response", "get_response"]],
    "generate_003": [["pandas", "pd"], ["drop_duplicates", "duplicates"], ["fillna", "dropna", "null", "na"]],
    "generate_004": [["bcrypt", "hash"], ["jwt", "jsonwebtoken"], ["register", "post"]],
    "refactor_001": [["auth", "order", "user", "module", "service", "import", "require"]],
    "refactor_002": [["config"]],
    "refactor_003": [["strategy", "interface", "class", "encapsulate", "behavior"]],
    "refactor_004": [["async"], ["await"], ["try", "catch"]],
    "refactor_005": [["validate", "validation", "validator", "import", "require", "export"]],
    "refactor_006": [["payment"]],
    "test_001": [["cart", "checkout", "payment", "order"], ["assert", "expect", "test", "should", "it("]],
    "test_002": [["stripe"], ["mock", "jest.mock", "patch", "mocker"]],
    "test_003": [["login"], ["401", "400", "unauthorized", "bad request", "jwt", "token"]],
    "test_004": [["locust", "httpuser"], ["search"]],
    "test_005": [["test"], ["none", "empty", "null", "invalid", "raise", "exception", "error"]],
    "test_006": [["fixture"], ["yield", "teardown", "conn", "db", "database"]],
    "composite_001": [["null"], ["test", "assert", "expect"]],
    "composite_002": [["payment"], [CASE, "#", "//", "/*"]],
    "composite_003": [["kafka"], ["lag", "partition", "async", "await", "promise", "thread"]],
    "composite_004": [["order"], ["test"]],
    "composite_005": [["leak", "pool", "connection", "close", "cleanup"]],
    "composite_006": [["user", "profile"], ["middleware", "auth", "token"]],
}
