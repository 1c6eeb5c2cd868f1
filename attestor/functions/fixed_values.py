"""Fixed values.

Everything in this file is data that results depend on: character classes, word lists, phrase
patterns, thresholds and name tables. Logic lives elsewhere.
"""

# --- character classes -------------------------------------------------------------------------
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E8\u06EA-\u06ED\u0640\u08D3-\u08FF]"
FOLD_DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E8\u06EA-\u06ED\u0640]"
CONTROLS = r"[\u200B-\u200F\u202A-\u202E\u2066-\u2069\uFEFF]"
LIGATURES = r"[\uFDFA\uFDFB\uFD3E\uFD3F\uFDF0-\uFDF9\uFDFD]"
ZERO_WIDTH_SPACE = r"[\u200B\u2060\uFEFF\u180E]"
WORD_BREAKS = r"\s\p{Z}\u060C\u061B\u061F.,;:!?()\[\]{}\u00AB\u00BB\"'\u201C\u201D\u2018\u2019\uFD3F\uFD3E\-\u2013\u2014\u0640\u2026/\\|*"
EMOJI = r"[\x{1F000}-\x{1FAFF}\u2600-\u27BF\u2B00-\u2BFF\x{E0020}-\x{E007F}][\uFE0F\u200D\x{1F000}-\x{1FAFF}\u2600-\u27BF\u2B00-\u2BFF\x{E0020}-\x{E007F}]*"
REPEATED_MARK = r"([!?؟.،,~*_=\-–—•·])\1{2,}"

# --- letter folds: same position in both strings; a longer "from" deletes ------------------------
ARABIC_FROM = "\u0623\u0625\u0622\u0671\u0672\u0673\u0624\u0626\u0649\u06CC\u06D0\u0629\u06A9\u06C0\u06D5\u0621"
ARABIC_TO = "\u0627" * 6 + "\u0648" + "\u064A" * 4 + "\u0647" + "\u0643" + "\u0647" * 2
MARKER_FROM = "\u0623\u0625\u0622\u0671\u0649\u0629"
MARKER_TO = "\u0627" * 4 + "\u064A" + "\u0647"
LATIN_FROM = "äçèéêíñóöüßàâáëïîôúùûœ"
LATIN_TO = "aceeeinoousaaaeiiouuuo"

# --- formulas of respect (normal spelling) -------------------------------------------------------
HONORIFICS = (
    r"(صلي الله عليه و ?(?:اله و ?)?سلم|عليه (?:الصلاه و ?)?السلام|رضي الله (?:عنه|عنها|عنهما|عنهم)"
    r"|رحمه الله(?: تعالي)?|عز و ?جل|سبحانه و ?تعالي|تبارك و ?تعالي|جل و ?علا)"
)

# --- stop words ----------------------------------------------------------------------------------
RETRIEVAL_STOP = (
    "من في علي عن ان الي ما لا قال هو هذا يا او ثم قد كان "
    "الله رسول النبي له به لم اذا حتي بن ابن ابي ابو حدثنا اخبرنا "
    "عنه عنها عنهما رضي يقول سمعت انه عليه وسلم صلي روي رواه"
).split()
STEM_STOP = "من في علي عن ان الي ما لا هو هذا او ثم قد كان له به لم اذا حتي هي التي الذي كل ذلك هل يا".split()
TITLE_STOP = (
    "من في علي عن ان الي ما لا هو هذا هذه او ثم قد كان له به لم "
    "اذا حتي هي التي الذي كل ذلك هل يا حكم ماحكم يجوز يجب مع بين عند "
    "حرام حلال جائز مكروه واجب مباح يحرم يحل تجوز شيخ الشيخ سوال سال اريد ابي ودي وش ايش كيف متي لماذا وهل فما وما"
).split()
BASELINE_STOP = "قال الله تعالي رسول صلي عليه وسلم النبي في من علي ان عن ما لا الحديث الشريف ورد جاء القران الكريم".split()
NAME_NOISE = "الشيخ شيخ الاسلام الامام العلامه الحافظ رحمه الله تعالي رحمهم قال يقول ذكر".split()
STEM_PREFIXES = ["وال", "بال", "فال", "كال", "لل", "ال", "و", "ف", "ب", "ل"]

# --- grade vocabulary (normal spelling) ----------------------------------------------------------
GRADE_FABRICATED = ["موضوع", "لا اصل له", "باطل", "مكذوب", "مختلق", "كذب", "ليس له اصل", "لا يعرف له اصل"]
GRADE_WEAK = [
    "ضعيف", "لا يصح", "لم يصح", "ليس بصحيح", "غير صحيح", "لا يثبت", "لم يثبت", "منكر", "معلول", "شاذ", "مضطرب", "واه",
    "متروك", "فيه ضعف", "فيه نظر", "لين", "منقطع", "معضل", "مجهول", "لا يحتج",
]
GRADE_ACCEPTED = ["صحيح", "حسن", "متفق عليه", "ثابت", "جيد", "قوي", "رجاله ثقات", "صححه", "حسنه"]
TRUSTED_COLLECTION = ["متفق عليه", "رواه البخاري", "رواه مسلم", "اخرجه البخاري", "اخرجه مسلم", "صحيح البخاري", "صحيح مسلم"]

# --- marker phrases, written in the folded spelling ----------------------------------------------
_NOT_AFTER_LETTER = r"(?<![ء-ي])"
_NOT_BEFORE_LETTER = r"(?![ء-ي])"
_RESPECT = r"(?:\s*(?:صلي\s+الله\s+عليه\s+و\s?(?:اله\s+و\s?)?سلم|ﷺ|عليه\s+(?:الصلاه\s+و\s?)?السلام|تعالي|سبحانه(?:\s+وتعالي)?|عز\s+وجل|جل\s+وعلا|تبارك\s+وتعالي))*"
_OPENED = r"(?:\s*[:：]\s*|\s*(?=[«“\"﴿(]))"
CANON_BRACKETS = r"﴿([^﴾]{3,2000})﴾"
CANON_MARKER = (
    r"(?i)(?:(?:قال\s+الله|يقول\s+الله|قال\s+تعالي|يقول\s+تعالي|قال\s+سبحانه|قال\s+ربنا|يقول\s+ربنا|قوله\s+(?:تعالي|سبحانه|عز\s+وجل)"
    r"|allah\s+(?:says|said)|the\s+qur'?an\s+says)" + _RESPECT + r"\s*[:،,]?\s*"
    r"|(?:(?:جاء|ورد|كما)\s+)?في\s+(?:القران(?:\s+الكريم)?|كتاب\s+الله|الايه(?:\s+الكريمه)?|قوله)" + _RESPECT + _OPENED + r"|in\s+the\s+qur'?an" + _OPENED + r")"
)
NARRATION_MARKER = (
    r"(?i)(?:(?:(?:قال|يقول)\s+(?:رسول\s+الله|النبي|الرسول|المصطفي|نبينا)|عن\s+(?:النبي|رسول\s+الله)[^.:؟!\n]{0,60}?(?:قال|انه\s+قال)"
    r"|سمعت\s+(?:النبي|رسول\s+الله)[^.:؟!\n]{0,40}?يقول"
    r"|ان\s+(?:النبي|رسول\s+الله)[^.:؟!\n]{0,60}?قال|قال\s+عليه\s+(?:الصلاه\s+و\s?)?السلام|قال\s+صلي\s+الله\s+عليه\s+وسلم"
    r"|the\s+prophet[^.:\n]{0,60}?said|messenger\s+of\s+allah[^.:\n]{0,60}?said)" + _RESPECT + r"\s*[:،,]?\s*"
    r"|(?:(?:جاء|ورد|كما)\s+)?في\s+الحديث(?:\s+(?:الشريف|الصحيح|القدسي|النبوي))?" + _OPENED + r"|حديث\s+(?:النبي|رسول\s+الله)" + _RESPECT + _OPENED
    + r"|" + _NOT_AFTER_LETTER + r"(?:ال)?حديث(?:\s+(?:الشريف|الصحيح|القدسي|النبوي))?\s*[:：]?\s*(?=[«“\"'‘]))"
)
SCHOLAR_MARKER = (
    _NOT_AFTER_LETTER + r"(?:قال|يقول|وقال|ويقول|قرر|ذكر|نقل\s+عن|قول)\s+"
    r"((?:بعض\s+|احد\s+|جمهور\s+|كبار\s+)?(?:اهل\s+العلم|العلماء|السلف|الفقهاء|المحدثين|الائمه|المفسرين"
    r"|(?:الامام|شيخ\s+الاسلام|العلامه|الحافظ|الشيخ|الفقيه)(?:\s+[ء-ي]+){1,3}"
    r"|ابن\s+[ء-ي]+(?:\s+[ء-ي]+)?))"
    r"(?:\s+(?:رحمه|رحمهم)\s+الله(?:\s+تعالي)?)?\s*(?:[:：]\s*|\s*(?=[«“\"(])|\s+ان\s+)"
)
SCHOLAR_GROUP = r"^(?:بعض\s+|احد\s+|جمهور\s+|كبار\s+)?(?:اهل\s+العلم|العلماء|السلف|الفقهاء|المحدثين|الائمه|المفسرين)$"
REQUEST = (
    r"(?i)(?:اعطني|اعطيني|هات(?:\s+لي)?|اذكر\s+لي|اريد|ابحث\s+لي\s+عن|اكتب\s+لي|الف\s+لي|جد\s+لي|زودني\s+ب|give\s+me|write\s+me|find\s+me|make\s+up|i\s+need)"
    r"[^.؟!\n]{0,50}?(?:حديث|ايه|دليل|اثر|نص|hadith|verse|ayah|evidence)[^.؟!\n]*"
)
PERSONAL = (
    r"(?i)" + _NOT_AFTER_LETTER + r"(?:هل\s+(?:يجوز|يحل|يصح|يحق)\s+لي|هل\s+يلزمني|(?:هل|ماذا)\s+علي\s+(?:شي|كفاره|اثم|قضاء|ذنب|ان)"
    r"|ما\s+حكم[^.؟!\n]{0,80}?(?:\sلي" + _NOT_BEFORE_LETTER + r"|زوجتي|زوجي|طلاقي|صلاتي|صيامي|عقدي|ابي|امي|اخي)"
    r"|انا\s+[^.؟!\n]{0,120}?هل\s+(?:يجوز|يحل|يصح)|(?:طلقت|حلفت|نذرت)\s+[^.؟!\n]{0,160}?(?:فما|هل|ماذا)"
    r"|is\s+it\s+(?:permissible|allowed|halal|haram)\s+for\s+me|in\s+my\s+(?:case|marriage|situation))[^.؟!\n]*"
)
RULING_QUESTION = r"(?:ما\s+(?:هو\s+)?(?:ال)?حكم|هل\s+(?:يجوز|يحل|يصح|يجب|يحرم|يكره|يستحب|يشرع|يلزم|يشترط|تجوز|تصح|تجب))"
# a statement that ends as a question; it can stand only where one of these words comes before the question mark
QUESTION_END = r"(?:حرام|حلال|جائز|مكروه|واجب|بدعه|مباح)\s*[؟?]"
QUESTION_ENDING = r"|[^.؟?!\n]{2,80}" + QUESTION_END
QUESTION = (
    r"(?i)" + _NOT_AFTER_LETTER + r"(?:" + RULING_QUESTION + r"[^.؟?!\n]*[؟?]?"
    r"|(?:ما\s+(?:معني|المقصود|الفرق|الدليل|هو|هي)|كيف|متي|لماذا|اين|كم|من\s+(?:هو|هي)|هل)" + _NOT_BEFORE_LETTER + r"[^.؟?!\n]*[؟?]"
    r"|(?:(?<=\n)|^)\s*(?:(?:وش|ايش|شو|اش)\s+)?(?:ال)?حكم\s+[^.؟?!\n]+[؟?]?"
    r"|(?:ابي|ابغي|ابغا|اريد|ودي|حاب|نبي|نبغي)\s+(?:ا|ن)?(?:عرف|معرفه)\s+(?:ما\s+(?:هو\s+)?)?(?:ال)?حكم[^.؟?!\n]*[؟?]?"
    r"|هل" + _NOT_BEFORE_LETTER + r"[^.؟?!\n]{0,80}?(?:حرام|حلال|جائز|مكروه|واجب|بدعه|شرك|مباح)" + _NOT_BEFORE_LETTER + r"[^.؟?!\n]*[؟?]?"
    + QUESTION_ENDING
    + r"|(?:what|how|why|when|is\s+it|can\s+i|should\s+i|does|do)\b[^.?!\n]*\?)"
)
QUESTION_WITHOUT_ENDING = QUESTION.replace(QUESTION_ENDING, "")
RULING_WORD = r"(?:حرام|حلال|جائز|مكروه|واجب|بدعه|مباح|شرك)"
TOPIC = (
    r"(?i)" + _NOT_AFTER_LETTER + r"[وفبلك]?(?:ال)?(?:الله|اله|رب|صلا|صلي|صوم|صيام|زكا|حج|عمره|وضو|غسل|طهار|تيمم|حلال|حرام|حكم|سنه|بدع|شرك|دين|اسلام|مسلم"
    r"|قران|ايه|سوره|حديث|نبي|رسول|رمضان|دعا|ذكر|مسجد|جنه|نار|توبه|ذنب|فتو|شرع|فقه|استخار|تقو|ايمان|كفر|نكاح|زواج|طلاق|ميراث|عباد"
    r"|جمعه|عيد|قبر|جناز|ربا|صدق|كفار|نذر|يمين|حجاب|عقيد|توحيد|تفسير|صحاب|سيره|اذان|اقام|قبله|ركع|سجود|تشهد|وتر|تراويح|هجر|جهاد|ملائك|يوم\s+القيامه|اخر)"
    r"|\b(?:allah|god|pray\w*|salah|fast\w*|ramadan|zakat|hajj|umrah|halal|haram|permissible|islam\w*|qur'?an|hadith|prophet|sunnah|wudu|mosque|sin|dua|fatwa|shari'?a\w*|muslim\w*|ayah|verse|surah)\b"
)
# what of these patterns a text without a letter of ARABIC_LETTER can match
ARABIC_LETTER = "[ء-ي]"
QUESTION_LATIN = "(?i)" + _NOT_AFTER_LETTER + "(?:" + QUESTION[QUESTION.rindex("(?:what|") :]
PERSONAL_LATIN = "(?i)" + _NOT_AFTER_LETTER + "(?:" + PERSONAL[PERSONAL.rindex(r"is\s+it\s+(?:permissible") :]
TOPIC_LATIN = "(?i)" + TOPIC[TOPIC.rindex(r"\b(?:allah") :]
_SAID = r"[وف]?[ينت]?(?:قال|قول|ذكر|خبر\w{0,2}|اخبر\w{0,2}|بين|امر\w{0,2}|نهي|نهانا|حث\w{0,2}|ضرب|اوصي|وصي|اوصانا|علم\w{0,2}|حذر\w{0,2}|رغب|وعد|بشر|شرع|دعا|وصف|شبه|فسر|لعن|حرم|احل|اباح|اوجب|فرض)"
_PROPHET = r"(?:ال|لل|بال|وال)?(?:نبي\w{0,2}|رسول\w{0,2}|مصطفي)"
ATTRIBUTION = (
    r"(?U)(?<!\w)" + _SAID + r"(?:\s+\w+){0,2}?\s+" + _PROPHET + r"(?!\w)"
    r"|(?<!\w)" + _PROPHET + r"(?:\s+\w+){0,5}?\s+" + _SAID + r"(?!\w)"
    r"|(?<!\w)(?:عن|حديث|قول|وصيه|سنه|هدي)\s+" + _PROPHET + r"(?!\w)"
    r"|(?<!\w)(?:جاء?|ورد|ثبت)\s+في\s+(?:الحديث|السنه)(?!\w)"
    r"|(?<!\w)" + _SAID + r"\s+(?:الله|تعالي|ربنا|سبحانه)(?!\w)"
    r"|(?<!\w)في\s+(?:القران|كتاب\s+الله|كتابه|محكم\s+التنزيل)(?!\w)"
)
ATTRIBUTION_EN = (
    r"(?i)\b(?:prophet|messenger)\b[^.!?]{0,60}\b(?:said|says|taught|told|commanded|ordered|forbade|prohibited|warned|promised|mentioned|explained|described|gave|advised|encouraged)\b"
    r"|\b(?:allah|god|the qur'?an)\b[^.!?]{0,30}\b(?:says|said|tells|told|commands|commanded|forbids|forbade|promises|promised|mentions|mentioned)\b"
    r"|\b(?:in|according to) (?:the|a) (?:hadith|sunnah|qur'?an)\b"
)
MENTIONS_PERSON = r"(?U)(?<!\w)[وف]?" + _PROPHET + r"(?!\w)|صلي الله عليه وسلم|عليه الصلاه والسلام|عليه السلام"
MENTIONS_PERSON_EN = r"(?i)\b(?:prophet|messenger of (?:allah|god)|pbuh|peace be upon him)\b"
PRESENTS = (
    r"(?U)(?<!\w)(?:هذا|هذه|هذي|ذا)\s+(?:ال)?(?:دعاء|حديث|ايه|ذكر|قول|دعوه|وصيه|اثر)(?!\w)"
    r"|(?<!\w)(?:قال|يقول|ودعا|دعا)\s*[:：]\s*$"
)
POINTS_AT_TEXT = r"(?U)(?<!\w)(?:هذا|هذه|هذي|ذا|ذي|حديث|الحديث|ايه|الايه|نص|النص|الكلام|القول|قران|القران|this|it|hadith|verse|ayah)(?!\w)"
AUTHENTICITY = r"(?U)(?<!\w)(?:صحيح|صحيحه|يصح|صحه|ثابت|ثابته|يثبت|ضعيف|ضعيفه|موضوع|مكذوب|اصل|حقيقي|حقيقيه|سند|authentic|sahih|weak|fabricated|true|real|correct)(?!\w)"
RULING_MENTION = r"(?U)(?<!\w)(?:حكم|يجوز|يحل|يجب|حرام|حلال)(?!\w)"
IS_THIS_TEXT = r"^(?:هل|is)\s+(?:هذا|هذه|هذي|ذا|this)\s+(?:ايه|حديث|قران|verse|hadith|ayah)\s*$"
EDITORS_NOTE = r"^\s*[\[(]?\s*(?:يعني|اي)\s+(?:حديث|الحديث)"
VAGUE_NAME = r"(?U)(?<!\w)(?:بعض|احد|علماء|العلماء|اهل|السلف|الحكماء|قيل|يقال|احدهم|الشاعر)(?!\w)"
QUOTING = r"(?U)(?<!\w)(?:قال|يقول|وقال|ويقول|قوله|ذكر|نقل|حكي)(?!\w)"
PERSON_NAMES = ["رسول الله", "النبي", "الرسول"]
OPENERS = {"«": "»", "“": "”", '"': '"', "'": "'", "‘": "’", "﴿": "﴾", "(": ")", "{": "}", "[": "]"}
SENTENCE_END = r"[.؟!\n…]"
SENTENCE_SPLIT = r"[.؟!\n؛]+"
EDGE_BREAK = r"[.؟?!\n«»﴿﴾\"“”:؛]"

# --- forwarded-message footers (normal spelling) -------------------------------------------------
FOOTERS = [
    r"^انشر(ها|وها|ه)?( توجر| توجروا| ولك الاجر| ولكم الاجر| في ميزان حسنات(ك|كم))?$",
    r"انشر(ها|وها|ه) (توجر|توجروا|ولك الاجر|ولكم الاجر)",
    r"لا (تدع|تجعل)(ها|ه) تقف عندك",
    r"^ارسل(ها|ه|وها) (ل|الي) ",
    r"^شارك(ها|وها|ه)?( مع .*)?$",
    r"لا تنس(وا|ي)? الصلاه علي النبي",
    r"امانه في (عنقك|رقبتك|اعناقكم)",
    r"^(منقول|للفايده|للنشر|رساله محوله|محوله|تمت اعاده التوجيه|تم التحويل|تمت اعاده توجيهها عده مرات)$",
    r"^(forwarded|forwarded many times|share (this|it)( .*)?|pass it on|please share)$",
]
CLOCK_LINE = r"(?i)^[^\p{L}\p{N}_]*[0-9]{1,2}:[0-9]{2}\s*(?:ص|م|am|pm)?[^\p{L}\p{N}_]*$"
DECORATION_LINE = r"^[^\p{L}\p{N}]+$"
NUMBERED_TITLE = r"(?:-|–)\s*\d+\s*$|^\s*(?:الشريط|اللقاء|الدرس|الحلقة)(?U)\b.*\d|^\s*\d+\s*$"

# --- states, actions, rules ----------------------------------------------------------------------
STATES = ["supported", "supported_with_note", "needs_review", "not_found", "contradicted"]
STATES_BY_RISK = ["contradicted", "not_found", "needs_review", "supported_with_note", "supported"]
STATE_ACTION = {
    "supported": "adopt",
    "supported_with_note": "correct_wording",
    "needs_review": "refer_to_scholars",
    "not_found": "remove_or_request_source",
    "contradicted": "remove_and_warn",
}
NO_COPY_RULES = [
    "hadith.possible_paraphrase", "hadith.partial", "hadith.too_short", "ayah.partial_unattributed",
    "ayah.below_threshold", "ayah.none", "hadith.none", "quote.none",
]
PREFIX_LENGTHS = [5, 7, 9, 12, 16, 20, 26, 34, 45]
# rule id -> (limits family, name of the threshold the rule compared with)
RULE_CATALOGUE = {
    "ayah.exact": ("ayah_found", None),
    "ayah.near": ("ayah_found", "canon_near"),
    "ayah.altered": ("ayah_found", "canon_near"),
    "ayah.altered_transcript": ("ayah_found", "canon_near"),
    "ayah.partial_unattributed": ("ayah_found", "canon_floor"),
    "ayah.below_threshold": ("ayah_not_found", "canon_floor"),
    "ayah.none": ("ayah_not_found", None),
    "hadith.accepted_exact": ("hadith_found", "graded_exact"),
    "hadith.accepted_near": ("hadith_found", "graded_required"),
    "hadith.possible_paraphrase": ("paraphrase", "graded_required"),
    "hadith.weak": ("hadith_found", "graded_required"),
    "hadith.fabricated": ("hadith_found", "graded_required"),
    "hadith.grading_conflict": ("hadith_found", "graded_required"),
    "hadith.grading_unclear": ("hadith_found", "graded_required"),
    "hadith.no_grading": ("hadith_found", "graded_required"),
    "hadith.partial": ("hadith_not_found", "graded_required"),
    "hadith.too_short": ("hadith_not_found", None),
    "hadith.none": ("hadith_not_found", "graded_floor"),
    "ruling.text_found": ("statement", None),
    "ruling.no_text": ("statement", None),
    "attribution.by_meaning": ("statement", None),
    "ruling.disputed": ("statement", None),
    "ruling.personal_case": ("statement", None),
    "quote.unnamed": ("quote", None),
    "quote.reported": ("quote", None),
    "quote.verbatim": ("quote", "saying_verbatim"),
    "quote.misattributed": ("quote", "saying_verbatim"),
    "quote.attribution_unknown": ("quote", "saying_verbatim"),
    "quote.none": ("quote", "saying_verbatim"),
    "question.referral": ("request", None),
    "request.no_fabrication": ("request", None),
}
ABSTAIN_CATEGORIES = ["fabrication_request", "no_source"]
PLAN_CATEGORIES = {
    "ayah_correct": 2, "ayah_altered_minor": 2, "ayah_altered_major": 1, "hadith_sahih_verbatim": 2, "hadith_sahih_abridged": 2,
    "english_hadith": 1, "quote_misattributed": 2, "no_source": 1, "hadith_weak": 1, "ruling_definitive": 2, "ruling_disputed": 2,
    "personal_case": 1, "fabrication_request": 1,
}
