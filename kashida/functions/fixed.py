"""Word lists, lookup tables, patterns and formats that results depend on. Each is stated once, as text."""

from __future__ import annotations

# White space as Unicode defines it, in a notation that Java and RE2 share.
BLANK = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The Arabic block, with its punctuation and digits.
ARABIC = r"\x{600}-\x{6FF}"

# Arabic letters and the Urdu ones they are stored as.
LETTERS_FROM, LETTERS_TO = "يكهةأإؤئ", "یکہہااوی"

# Words that decide a theme, in order of precedence.
THEMES = {
    "love": ["عشق", "محبت", "دل", "غم", "اشک", "آرزو", "دیدار", "فراق", "وصل"],
    "spiritual": ["خدا", "رب", "اللہ", "دعا", "رحمت", "عشق حقیقی", "تصوف"],
    "politics": ["سیاست", "حکومت", "انصاف", "آزادی", "وطن", "ملت"],
}
# Words that show an emotion.
EMOTIONS = {
    "love": ["محبت", "عشق", "دل", "آرزو", "دیدار", "وصل"],
    "sadness": ["غم", "درد", "تنہائی", "اشک", "فراق", "ہجر"],
    "hope": ["امید", "روشنی", "خوشی", "آزادی", "سحر"],
}
# Letters and marks that make a syllable long; letters that count as vowels elsewhere.
LONG_VOWELS = "اآویےَُِ"
VOWELS = "اویئءآ"
# Names of metres by their patterns of long (L) and short (S) words.
METRES = {"LSLSLSLS": "Hazaj", "SLSLSLSL": "Ramal", "LLSLLSLL": "Mutaqarib", "LSLLSLL": "Khafif"}

# Weights of an explained similarity, of a poet's fingerprint, and of shared words.
EXPLAINED = {"semantic": 0.5, "radif": 0.2, "qaafiya": 0.2, "theme": 0.1}
FINGERPRINT = {"embedding": 0.6, "radif": 0.2, "qaafiya": 0.1, "vocabulary": 0.1}
SHARED_WORDS, SAME_POET = 0.7, 0.15

# Latin spellings of Urdu words.
ROMAN = {
    "mohabbat": "محبت", "ishq": "عشق", "pyar": "پیار", "dard": "درد", "zindagi": "زندگی", "raat": "رات", "tanhaai": "تنہائی", "yaad": "یاد", "dil": "دل", "aankh": "آنکھ",
    "lab": "لب", "chehra": "چہرہ", "husn": "حسن", "khuda": "خدا", "zaman": "زمان", "safar": "سفر", "manzil": "منزل", "dunya": "دنیا", "khushi": "خوشی", "gham": "غم",
    "aansu": "آنسو", "rooh": "روح", "jaan": "جان", "yeh": "یہ", "woh": "وہ", "hai": "ہے", "hain": "ہیں", "tha": "تھا", "thi": "تھی", "the": "تھے", "main": "میں", "tu": "تو",
    "ap": "آپ", "us": "اس", "is": "اس", "ko": "کو", "se": "سے", "ka": "کا", "ki": "کی", "ke": "کے", "par": "پر", "mein": "میں", "ne": "نے", "ghalib": "غالب", "iqbal": "اقبال",
    "faiz": "فیض", "mir": "میر", "faraz": "فراز", "parveen": "پروین", "shakir": "شاکر", "nasir": "ناصر", "kazmi": "کاظمی", "sahir": "ساحر", "ludhianvi": "لدھیانوی",
}
# English words with their Urdu ones.
ENGLISH = {
    "night": "رات", "love": "محبت", "lonely": "تنہائی", "alone": "تنہا", "sad": "غم", "happy": "خوش", "heart": "دل", "life": "زندگی", "death": "موت", "sky": "آسمان",
    "moon": "چاند", "star": "ستارہ", "flower": "پھول", "garden": "گلشن", "friend": "دوست", "enemy": "دشمن", "pain": "درد", "sorrow": "غم", "hope": "امید", "waiting": "انتظار",
}
# Latin letters and groups with their Urdu letters: by length, and in the order in which the other table replaces them.
LATIN_LETTERS = {
    "a": "ا", "b": "ب", "p": "پ", "t": "ت", "s": "س", "j": "ج", "ch": "چ", "h": "ہ", "kh": "خ", "d": "د", "z": "ز", "r": "ر", "sh": "ش", "gh": "غ", "f": "ف", "q": "ق", "k": "ک",
    "g": "گ", "l": "ل", "m": "م", "n": "ن", "v": "و", "w": "و", "y": "ی", "e": "ے", "i": "ی", "u": "و", "o": "و", "aa": "آ", "ee": "ی", "oo": "و",
}
LATIN_IN_ORDER = {
    "a": "ا", "b": "ب", "p": "پ", "t": "ت", "s": "س", "j": "ج", "ch": "چ", "h": "ہ", "k": "ک", "d": "د", "r": "ر", "z": "ز", "gh": "غ", "f": "ف", "q": "ق", "l": "ل", "m": "م",
    "n": "ن", "w": "و", "y": "ی", "aa": "آ", "ee": "ی", "oo": "و", "sh": "ش", "kh": "خ",
}
# Urdu words with English ones; of words given twice the later counts.
URDU_ENGLISH = {
    "دل": "heart", "ہے": "is", "تو": "you", "نہ": "not", "سنگ": "stone", "خشت": "brick", "درد": "pain", "بھر": "fill", "آئے": "come", "کیوں": "why", "روئیں": "weep", "ہم": "we",
    "ہزار": "thousand", "بار": "times", "کوئی": "someone", "ستائے": "torment", "غم": "sorrow", "حیات": "life", "کا": "of", "مزا": "pleasure", "مجھے": "me", "بتائے": "tell",
    "دھڑکنے": "beating", "سبب": "reason", "پوچھے": "ask", "جائے": "go", "عشق": "love", "نے": "did", "غالب": "Ghalib", "نکما": "useless", "کر": "do", "دیا": "gave",
    "ورنہ": "otherwise", "آدمی": "man", "تھے": "were", "کام": "work", "کے": "of", "خدا": "god", "رب": "lord", "دنیا": "world", "زندگی": "life", "موت": "death", "آنکھ": "eye",
    "لب": "lips", "چاند": "moon", "ستارہ": "star", "صبح": "morning", "شام": "evening", "رات": "night", "یاد": "memory", "انتظار": "waiting", "سفر": "journey",
    "منزل": "destination", "وفا": "loyalty", "آسمان": "sky", "زمین": "earth", "پانی": "water", "آگ": "fire", "ہوا": "air", "پھول": "flower", "محبت": "love", "دوست": "friend",
    "غمگین": "sad", "خوش": "happy", "صبر": "patience", "قیس": "Qais", "لیلیٰ": "Laila", "آشفتہ": "distraught", "سری": "head", "چھوڑا": "left", "بادہ": "wine", "کش": "drinker",
    "گلشن": "garden", "بیٹھے": "sit", "عہد": "era", "گل": "flower", "ختم": "ended", "ٹوٹ": "broke", "ساز": "instrument", "چمن": "garden", "تھا": "was", "عجب": "wonderful",
    "تیرے": "your", "جہاں": "world", "منظر": "scene", "پر": "on", "تیرا": "your", "نام": "name", "تلوار": "sword", "اٹھائی": "raised", "کس": "who", "تھی": "was", "کچھ": "some",
    "تیغ": "sword", "زنی": "strike", "اپنی": "own", "حکومت": "government", "کی": "of", "ہیبت": "awe", "صنم": "idol", "سہمے": "fearful", "رہتے": "remain", "امتیں": "nations",
    "اور": "and", "بھی": "also", "ان": "them", "میں": "in", "گنہگار": "sinner", "پھر": "then", "یہ": "this", "آزردگی": "annoyance", "غیر": "other", "کیا": "what",
    "معنی": "meaning", "وادی": "valley", "نجد": "Najd", "شور": "noise", "سلاسل": "chains", "رہا": "remained", "جوئے": "stream", "خوں": "blood", "حسرت": "longing",
    "دیرینہ": "ancient", "پرانی": "old", "روشیں": "ways", "باغ": "garden", "ویراں": "deserted", "ہوئیں": "became", "چاک": "torn", "بلبل": "nightingale", "تنہا": "alone",
    "نوا": "melody", "بت": "idol", "خانوں": "houses", "کہتے": "say", "مسلمان": "Muslims", "گئے": "went", "ستاروں": "stars", "آگے": "beyond", "ہیں": "are",
}
# Urdu phrases with English ones.
PHRASES = {
    "دل ہی تو ہے": "the heart is", "نہ سنگ و خشت": "not stone or brick", "درد سے بھر": "filled with pain", "ہزار بار": "a thousand times", "کوئی ہمیں ستائے": "someone torments us",
    "ہم نے مانا": "we admit", "کہ تغافل نہ کرو گے": "that you will not ignore", "خاک ہو جائیں گے": "will turn to dust", "تم کو خبر ہونے تک": "until you know",
    "یہ نہ تھی ہماری قسمت": "this was not our destiny", "کہ وصال یار ہوتا": "that we would meet the beloved", "اگر اور جیتے رہتے": "if we had lived longer",
    "یہی انتظار ہوتا": "this is what we waited for", "درد لیلیٰ بھی وہی قیس کا پہلو بھی وہی": "The pain of Laila is the same, the side of Qais is the same",
    "عشق کو عشق کی آشفتہ سری کو چھوڑا": "Love left the distraught head of love",
    "بادہ کش غیر ہیں گلشن میں لب جو بیٹھے": "Wine‑drinkers are others; the lips that sit in the garden",
    "عہد گل ختم ہوا ٹوٹ گیا ساز چمن": "The era of the flower ended, the instrument of the garden broke",
    "ہم سے پہلے تھا عجب تیرے جہاں کا منظر": "Before us, the scene of your world was wonderful",
    "پر ترے نام پہ تلوار اٹھائی کس نے": "But who raised the sword in your name?",
    "تھی نہ کچھ تیغ زنی اپنی حکومت کے لیے": "There was no sword‑striking for one’s own rule",
    "کس کی ہیبت سے صنم سہمے ہوئے رہتے تھے": "From whose awe did the idols remain fearful?",
    "امتیں اور بھی ہیں ان میں گنہ گار بھی ہیں": "There are other nations, and among them are sinners too",
    "پھر یہ آزردگی غیر سبب کیا معنی": "Then what does this annoyance without reason mean?",
    "وادی نجد میں وہ شور سلاسل نہ رہا": "In the valley of Najd, that noise of chains did not remain",
    "جوئے خوں می چکد از حسرت دیرینۂ ما": "The stream of blood flows from the longing of our old days",
    "وہ پرانی روشیں باغ کی ویراں بھی ہوئیں": "Those old ways of the garden have become desolate too",
    "چاک اس بلبل تنہا کی نوا سے دل ہوں": "The hearts are torn by the melody of this lonely nightingale",
    "بت صنم خانوں میں کہتے ہیں مسلمان گئے": "In idol houses, they say the Muslims have gone",
    "ستاروں سے آگے جہاں اور بھی ہیں": "Beyond the stars, there are other worlds too",
}
# What groups of a feature vector's places stand for, and places of their own.
FEATURE_GROUPS = [
    "Vocabulary richness", "Syntactic patterns", "Rhythmic structure", "Morphological features", "Phonetic style", "Lexical density", "Poetic imagery", "Repetition patterns",
    "Syllable distribution", "Emotional tone",
]
FEATURES = ["Radif (refrain) pattern", "First Qaafiya (rhyme) pattern", "Second Qaafiya pattern", "Third Qaafiya pattern", "Meter (behr) pattern", "Theme category", "Number of verses"]
# The separator of texts in an upload, and what a poet without verses shows.
SEPARATOR, NO_COUPLET = "###GHZ###", "✨"
# The lines that explain a likeness, with the places of their numbers and words.
EXPLANATIONS = {
    "semantic": "Semantic similarity (%.2f) → %.1f%%", "radif": "Same radif '%s' → 20%%", "no radif": "Different radif → 0%",
    "qaafiya": "Qaafiya overlap (%.2f) → %.1f%%", "no qaafiya": "No qaafiya overlap → 0%", "theme": "Same theme '%s' → 10%%", "no theme": "Different theme → 0%",
}
