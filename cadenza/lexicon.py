"""Word lists, names and constants of the transcript operators. All values here are fixed: results depend on each."""

# Words that may open a clip after a pause.
DISCOURSE_MARKERS = ["actually", "also", "anyway", "basically", "listen", "look", "now", "okay", "right", "so", "uh", "um", "well", "yeah"]
# Words that need context before them.
SUBORDINATORS = ["and", "because", "but", "however", "or", "since", "that", "then", "therefore", "though", "thus", "unless", "whereas", "which", "while"]
# Words on which a clip shouldn't end.
DANGLING_ENDINGS = [
    "a", "an", "and", "are", "as", "at", "because", "but", "for", "her", "his", "if", "in", "is", "my",
    "of", "on", "or", "our", "so", "that", "the", "their", "to", "was", "were", "when", "which", "with", "your",
]
# Fillers of one word and of two.
FILLER_WORDS = ["actually", "ah", "basically", "eh", "erm", "hmm", "kinda", "like", "literally", "mhm", "okay", "right", "uh", "um", "y'know", "yeah"]
FILLER_PHRASES = ["and stuff", "i guess", "i mean", "kind of", "or whatever", "sort of", "you know", "you see"]
# Phrases that open weakly.
WEAK_OPENING_PHRASES = ["and then", "i guess", "i mean", "it was", "kind of", "so yeah", "sort of", "that is", "the thing is", "which is", "you know"]
# Ends of sentences.
SENTENCE_END = [".", "!", "?", "…"]
# Words without weight in similarity.
STOPWORDS = [
    "a", "about", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do", "does", "down", "for", "from", "he", "her", "here",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "like", "my", "no", "not", "of", "on", "or", "our", "out", "over",
    "she", "so", "than", "that", "the", "their", "them", "then", "there", "they", "this", "to", "up", "was", "we", "were", "what", "when", "why",
    "with", "you", "your",
]
# Suffixes in the order in which they are tried.
SUFFIXES = ["ing", "ed", "es", "s", "ly", "er"]
# Categories of moments.
CATEGORIES = ["advice", "controversial", "curiosity", "debate", "educational", "emotional", "funny", "insight", "quote", "revelation", "story", "surprising"]
# What a rejection says, and its label.
REJECTION_KINDS = [
    ("degenerate span", "spans too short to locate anything"),
    ("do not match the transcript", "invented timestamps"),
    ("No valid JSON", "unparseable output"),
    ("Expected a JSON array", "wrong JSON shape"),
    ("missing start/end", "missing timestamps"),
    ("not an object", "malformed entries"),
]
# Weights of a boundary's components and of a candidate's final score.
BOUNDARY_WEIGHTS = {"opener": 0.28, "starts_sentence": 0.18, "ends_sentence": 0.24, "not_dangling": 0.12, "low_filler": 0.10, "duration_fit": 0.08}
SCORING_WEIGHTS = {"llm_score": 0.30, "rerank": 0.35, "boundary": 0.20, "duration_fit": 0.08, "diversity": 0.07}
