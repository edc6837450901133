"""Fixed values. They are part of the data format and must not be changed:
the order of the labels decides class ids and which label a parsed output gets.
"""

# fixed values: label vocabulary, in class-id order
LABELS = ["joy", "sadness", "anger", "fear", "love", "neutral"]

# fixed values: label of an output that names no label, class of an unknown label
FALLBACK_LABEL = "neutral"
UNKNOWN_CLASS = 0

# fixed values: worked examples of the few-shot prompt, (text, label)
FEW_SHOT_EXAMPLES = [
    ("I'm walking on sunshine and it feels so good", "joy"),
    ("I cry myself to sleep every night", "sadness"),
    ("I hate everything you put me through", "anger"),
    ("Every noise in the dark makes me tremble", "fear"),
    ("I'd cross the ocean just to hold you close", "love"),
    ("It's just another normal day, nothing special", "neutral"),
]

# fixed values: prompt wording; {labels}, {text} and {label} are filled in
PROMPT_INTRO = "You are an emotion classifier for song lyrics.\n\nPossible emotions: {labels}.\n\n"
PROMPT_EXAMPLES_TITLE = "Here are labeled examples:\n\n"
PROMPT_EXAMPLE = "Lyric: {text}\nEmotion: {label}\n\n"
PROMPT_TASK = (
    "Classify the emotion of the following lyric.\n"
    "Answer with ONLY one word from this list: {labels}.\n\n"
    "Lyric: "
)
PROMPT_END = "\nEmotion:"
ANSWER_MARKER = "Emotion:"

# fixed values: code points kept in saved predictions
SAVED_TEXT_CHARS = 200
SAVED_OUTPUT_CHARS = 100

# fixed values: smoothing of the sampling weights, bar width of the comparison
COUNT_SMOOTHING = 1e-6
BAR_WIDTH = 40

# fixed values: field contents that a CSV reader takes for a missing value
MISSING_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
MISSING_TEXT = "nan"

# fixed values: the characters that stripping removes at both ends
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
