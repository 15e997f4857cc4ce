"""Word lists and patterns of the text operators.

Fixed values: their contents must be as they are for the operators' results to be right.
"""

from __future__ import annotations

STOPWORDS = (
    "a an the is are was were be been being do does did doing have has had i you he she we they it me him her us them "
    "my your his their our its and or but if so to of in on at for with by from this that these those as than then"
).split()

QUESTION_STARTERS = "what why how when where can should do does is are kya kab kaise kaisa kahan".split()

# Negation.
NEGATION_CUES = (
    "not no never without cannot cant wont shouldnt couldnt doesnt didnt isnt arent wasnt werent havent hasnt hadnt dont none neither nor"
).split()
NEGATION_BOUNDARIES = [",", ".", ";", "?", "!", "but", "however", "yet", "although", "though", "while", "whereas", "except"]
NEGATION_WINDOW = 4

# Sentiment.
POSITIVE = {
    "good": 1.5, "great": 2.0, "fine": 1.0, "okay": 0.8, "ok": 0.8, "better": 1.5, "best": 2.0, "thanks": 1.5, "thank": 1.5, "appreciate": 1.5,
    "helpful": 1.5, "helped": 1.5, "love": 2.5, "like": 1.0, "happy": 2.0, "calm": 1.0, "relieved": 1.5, "safe": 1.2, "easy": 1.0, "comfortable": 1.5,
    "improved": 1.5, "stable": 1.0, "healthy": 1.2, "strong": 1.0, "yes": 0.5, "fixed": 1.5, "recovered": 2.0, "clear": 1.0,
}
NEGATIVE = {
    "bad": -1.5, "worse": -2.0, "worst": -2.5, "useless": -2.5, "garbage": -2.5, "stupid": -2.0, "rubbish": -2.0, "sucks": -2.0, "terrible": -2.5,
    "awful": -2.5, "horrible": -2.5, "scared": -2.0, "scary": -2.0, "afraid": -2.0, "worried": -1.5, "worry": -1.5, "anxious": -1.5, "anxiety": -1.5,
    "frustrated": -1.8, "angry": -2.0, "annoyed": -1.5, "upset": -1.5, "sad": -1.5, "tired": -0.8, "fatigue": -0.8, "fatigued": -0.8, "weak": -0.8,
    "pain": -1.2, "ache": -1.0, "aching": -1.0, "hurts": -1.2, "hurt": -1.2, "sore": -0.8, "swelling": -0.6, "stiff": -0.6, "dizzy": -1.0,
    "fainting": -1.5, "nausea": -1.0, "vomiting": -1.5, "bleeding": -1.5, "blurred": -1.0, "numb": -1.0, "numbness": -1.0, "burning": -1.0,
    "tight": -0.6, "tightness": -1.0, "breathless": -1.5, "broken": -1.5, "broke": -1.5, "emergency": -2.0, "urgent": -1.5, "severe": -2.0, "no": -0.4,
}
INTENSIFIERS = {"very": 1.5, "really": 1.4, "super": 1.5, "extremely": 1.8, "so": 1.3, "too": 1.3, "much": 1.3, "lots": 1.3}
DIMINISHERS = {"slightly": 0.5, "somewhat": 0.6, "barely": 0.4, "hardly": 0.4}

# Tiers of urgent phrases, as patterns between word borders.
SEVERE = [
    "crushing chest pain", "severe chest pain", "cant breathe", "can ?not breathe", "struggling to breathe", "gasping", "passing out", "passed out", "fainted",
    "unconscious", "not breathing", "blue lips", "blue around the mouth", "turning blue", "stroke symptoms", "face drooping", "slurred speech",
    "one side weak(ness)?", "arm went numb", "coughing up blood", "vomiting blood", "blood in (stool|urine|vomit)", "suicid(e|al)", "heart attack", "had a stroke", "seizure",
]
MODERATE = [
    "chest pain", "pain in (my |the )?chest", "chest hurts?", "chest tightness", "chest tight", "heart pain", "pain in (my |the )?heart", "heart hurts?", "heart problem",
    "severe headache", "shortness of breath", "very breathless", "fast heart", "racing heart", "bleeding heavily", "blurred vision", "numbness", "weakness on one side",
    "severe pain", "collapsed", "very dizzy", "sudden weight loss", "high fever", "40 ?degrees", "dil (mein|ka) dard", "dil ka masla", "seenay mein dard",
]
MILD = ["worried", "anxious", "scared", "feel awful", "sharp pain", "sudden pain", "getting worse", "hurts a lot", "really hurts", "cant sleep", "nausea", "vomiting"]

# Question types.
AUXILIARIES = "is are was were do does did can could should shall will would may might must have has had am".split()
WH = {"what": "what", "whats": "what", "why": "why", "how": "how", "hows": "how", "when": "when", "where": "where", "who": "who", "whos": "who", "which": "which"}
ASKING = ["tell", "show", "give", "explain"]

# Rule intents.
META_PHRASES = [
    "who are you", "what are you", "what is your name", "what's your name", "whats your name", "your name",
    "who made you", "who built you", "who created you", "who developed you", "who designed you", "tell me about yourself", "introduce yourself", "are you a robot",
    "are you a bot", "are you ai", "are you a human", "are you human", "are you a doctor", "are you a real doctor", "are you real", "what model are you",
    "are you chatgpt", "are you gpt", "are you claude", "are you a language model",
]
MEDICAL_HINTS = (
    "pain ache hurt hurts hurting sore sick ill fever cough blood swelling swollen dizzy vomit vomiting nausea breath breathless breathing rash wound burn bleed bleeding numb "
    "heart chest head back knee leg arm stomach neck shoulder hip ankle wrist throat eye ear tooth ribs lung kidney liver skin mri ct scan xray ultrasound ecg ekg echo biopsy stent "
    "angiogram physio rehab bp cholesterol diabetes hypertension stroke afib angina asthma medicine medication drug tablet pill dose appointment report "
    "dard dil sar kamar pet khansi bukhar ghutna ghutne seenay saans kharish"
).split()
GREETINGS = ["hi", "hello", "hey", "hiya", "yo", "salaam", "salam", "assalam", "good morning", "good afternoon", "good evening", "good night", "hi there", "hey there", "howdy", "greetings"]
THANKS = ["thanks", "thank you", "thx", "thankyou", "ty", "appreciate it", "appreciated", "much appreciated", "shukria", "shukriya", "cheers", "jazak allah", "many thanks"]
FRUSTRATION = ["wtf", "wth", "ugh", "ffs", "useless", "stupid", "garbage", "this sucks", "this is bad", "rubbish", "useless bot", "you suck", "lame", "boring"]
HELP = ["help", "what can you do", "what do you do", "menu", "options", "topics", "categories"]

# Tags of question-answer texts, by substrings.
TAG_RULES = {
    "imaging": ["mri", "ct ", "x-ray", "xray", "ultrasound", "scan ", "imaging", "echocardiogram", "ecg", "ekg", "holter"],
    "physio": ["exercise", "physio", "rehab", "stretch", "session"],
    "cardio": ["blood pressure", "bp ", "heart", "cholesterol", "stroke", "afib", "angina", "statin", "aspirin"],
    "preparation": ["fast", "before your", "preparation", "prepare"],
    "recovery": ["recover", "after", "return", "rest"],
    "warning": ["warning", "emergency", "call 1122", "see your doctor", "see a doctor"],
    "medication": ["medicine", "tablet", "dose", "drug", "side effect"],
}

# Keyword bags of the specialties, in the order that decides ties.
SPECIALTY_KEYWORDS = {
    "radiology": ["mri", "ct", "x-ray", "xray", "scan", "ultrasound", "imaging", "contrast", "gadolinium", "iodine", "radiology", "radiologist", "mammogram", "biopsy", "dexa", "fluoroscopy", "pet", "tracer", "claustrophobic", "claustrophobia", "metallic", "implant", "tattoo", "pacemaker scan"],
    "physiotherapy": ["physio", "physiotherapy", "physiotherapist", "rehab", "exercise", "stretch", "stretching", "tens", "ultrasound therapy", "knee", "shoulder", "elbow", "ankle", "wrist", "hip", "back", "neck", "sciatica", "sprain", "strain", "rotator", "meniscus", "acl", "tendon", "ligament", "posture", "ergonomic", "gait", "balance"],
    "cardiovascular": ["heart", "cardiac", "cardio", "cardiology", "cardiologist", "chest", "angina", "stent", "bypass", "cabg", "bp", "blood pressure", "hypertension", "cholesterol", "statin", "aspirin", "ecg", "ekg", "holter", "echo", "echocardiogram", "angiogram", "stroke", "afib", "atrial fibrillation", "palpitation", "palpitations", "arrhythmia", "ldl", "hdl", "pacemaker", "valve", "dil", "seenay", "dard"],
}

OUT_OF_SCOPE = (
    "erectile erection impotence viagra cialis penis vagina testicle prostate ejaculat intercourse orgasm porn masturbat sperm fertility infertility ivf contraceptive condom abortion "
    "menstruation menstrual uti std sti hiv herpes gonorrhea syphilis lulli lund chuchi boobs shagal mardana nifas bitcoin ethereum stock trading loan homework assignment javascript "
    "python react recipe cooking biryani pizza football cricket movie song netflix"
).split()

PRONOUNS = ["it", "this", "that", "they", "them", "those", "these"]
FOLLOWUP_STARTS = "why how what when where who which and but so or yes no ok okay".split()
MORE_WORDS = "more elaborate explain again also still".split()
FOLLOWUP_PHRASES = ["tell me more", "tell me about", "go on", "anything else", "what about", "how about", "and what", "and how"]

SYNONYMS = {
    "mri": ["magnetic resonance imaging", "mr scan"], "ct": ["computed tomography", "cat scan"], "xray": ["x ray", "radiograph", "plain film"], "ultrasound": ["sonography", "us scan", "echo"],
    "scan": ["imaging", "study"], "contrast": ["dye", "gadolinium", "iodine"], "report": ["result", "findings"], "bp": ["blood pressure"], "hbp": ["high blood pressure", "hypertension"],
    "hypertension": ["high blood pressure", "hbp", "bp meds", "blood pressure medicine"], "blood pressure": ["bp", "hypertension"], "blood pressure medicine": ["hypertension", "bp medicine"],
    "ldl": ["bad cholesterol"], "hdl": ["good cholesterol"], "mi": ["heart attack", "myocardial infarction"], "heart attack": ["mi", "cardiac arrest", "myocardial infarction"],
    "afib": ["atrial fibrillation", "a fib"], "ecg": ["ekg", "electrocardiogram"], "ekg": ["ecg", "electrocardiogram"], "echo": ["echocardiogram"], "stroke": ["cva", "brain attack"],
    "chf": ["heart failure", "congestive heart failure"], "angina": ["chest pain", "cardiac pain"], "palpitation": ["palpitations", "racing heart", "heart racing"],
    "physio": ["physiotherapy", "physical therapy", "pt"], "rehab": ["rehabilitation"], "sore": ["soreness", "ache", "tender"], "pain": ["ache", "hurts", "hurt"], "stretch": ["stretching", "stretches"],
    "exercise": ["workout", "activity", "physical activity"], "med": ["medicine", "medication", "drug", "pill", "tablet"], "meds": ["medicines", "medications", "drugs", "pills", "tablets"],
    "preg": ["pregnant", "pregnancy"], "pregnant": ["pregnancy", "preg"], "kid": ["child", "children", "kids"], "doc": ["doctor", "dr", "physician", "clinician"], "side effect": ["side effects", "adverse effect"],
    "diet": ["food", "eating", "nutrition"], "salt": ["sodium", "salty"], "smoke": ["smoking", "tobacco"], "drink": ["alcohol", "beer", "wine"], "sleep": ["sleeping", "rest"],
    "dizzy": ["dizziness", "light headed", "lightheaded"], "tired": ["fatigue", "fatigued", "weak", "weakness"], "swell": ["swelling", "swollen", "oedema", "edema"],
    "breathless": ["short of breath", "shortness of breath", "sob"],
}

# Roman Urdu words with their English senses; those without a sense are only recognised.
ROMAN_URDU = {
    "sar": ["head"], "sir": ["head"], "ankh": ["eye"], "ankhain": ["eyes"], "kaan": ["ear"], "kan": ["ear"], "kaano": ["ears"], "naak": ["nose"], "moo": ["mouth"], "munh": ["mouth"], "dant": ["tooth"], "daant": ["tooth"],
    "haath": ["hand"], "haat": ["hand"], "ungli": ["finger"], "unglian": ["fingers"], "kandha": ["shoulder"], "kandhe": ["shoulder"], "kohni": ["elbow"], "ghutna": ["knee"], "ghutne": ["knee"], "ghutno": ["knees"],
    "paer": ["foot", "leg"], "paair": ["foot"], "paaon": ["foot"], "tang": ["leg"], "tangain": ["legs"], "kamar": ["back", "lower back"], "peeth": ["back"], "peet": ["back"], "pet": ["stomach", "abdomen"], "peeit": ["stomach"],
    "seena": ["chest"], "seenay": ["chest"], "chaati": ["chest"], "dil": ["heart"], "khoon": ["blood"], "jisam": ["body"], "dard": ["pain", "ache"], "takleef": ["pain", "discomfort"], "kharish": ["itching"],
    "soozish": ["swelling"], "soozan": ["swelling"], "garam": ["fever", "hot"], "bukhar": ["fever"], "khansi": ["cough"], "zukam": ["cold", "flu"], "matli": ["nausea"], "ulti": ["vomiting"], "ghabrahat": ["anxiety"],
    "chakar": ["dizziness"], "chakkar": ["dizziness"], "kamzori": ["weakness"], "thakaan": ["fatigue"], "neend": ["sleep"], "saans": ["breath"], "ghutan": ["tightness"],
    "hai": [], "hain": [], "ho": [], "hoga": [], "kya": ["what"], "kab": ["when"], "kahan": ["where"], "kaise": ["how"], "kyon": ["why"], "kyun": ["why"], "kyunke": ["because"], "nahi": ["no", "not"], "nahin": ["no", "not"],
    "haan": ["yes"], "thora": ["a little"], "thoda": ["a little"], "bohot": ["a lot", "very"], "bahut": ["a lot", "very"], "ziada": ["more"], "zyada": ["more"], "thik": ["fine", "ok"], "theek": ["fine", "ok"], "buri": ["bad"],
    "bura": ["bad"], "achi": ["good"], "acha": ["good"], "accha": ["good"], "scan": ["scan"], "test": ["test"], "dawai": ["medicine"], "dawaiyan": ["medicines"], "dawa": ["medicine"], "doctor": ["doctor"], "doctar": ["doctor"],
    "hospital": ["hospital"], "clinic": ["clinic"], "report": ["report", "result"], "elaaj": ["treatment"], "ilaj": ["treatment"], "subah": ["morning"], "shaam": ["evening"], "raat": ["night"], "din": ["day"],
    "kal": ["yesterday", "tomorrow"], "aaj": ["today"], "abhi": ["now"], "phir": ["again"], "ami": ["mother"], "ammi": ["mother"], "maa": ["mother"], "abu": ["father"], "abbu": ["father"], "baba": ["father"], "bhai": ["brother"],
    "behan": ["sister"], "bacha": ["child"], "bachay": ["children"], "bachi": ["girl"], "salaam": ["hello"], "salam": ["hello"], "assalam": ["hello"], "assalamoalaikum": ["hello"], "shukria": ["thanks"], "shukriya": ["thanks"],
    "mehrbani": ["thanks"], "mera": [], "meri": [], "mere": [], "mujhe": [], "aap": [], "tum": [], "apne": [], "apni": [], "apna": [], "ka": [], "ki": [], "ke": [], "mein": [], "se": [], "par": [], "kuch": [], "masla": ["problem"],
    "maslay": ["problem"], "masail": ["problems"], "tabiat": ["health"], "tabyat": ["health"], "halat": ["condition"], "shikayat": ["complaint"], "shikayet": ["complaint"], "ilaaj": ["treatment"], "goli": ["tablet"],
    "operation": ["surgery"], "behtar": ["better"], "ghabraahat": ["anxiety"],
}

# Phrases of the dictionary tagger.
ENTITIES = {
    "BODY": "head|neck|shoulder|arm|elbow|wrist|hand|finger|fingers|chest|rib|ribs|back|spine|hip|thigh|knee|ankle|foot|feet|toe|toes|leg|calf|stomach|abdomen|belly|pelvis|muscle|muscles|tendon|ligament|nerve|bone|heart|brain|lung|lungs|liver|kidney|kidneys|skin|eye|eyes|ear|ears|throat|mouth|tongue|jaw|lower back|upper back|rotator cuff|achilles tendon|calf muscle|shoulder blade",
    "SYMPTOM": "pain|ache|soreness|stiffness|swelling|dizziness|tiredness|fatigue|shortness of breath|breathlessness|palpitations|palpitation|fluttering|tightness|pressure|burning|numbness|tingling|weakness|fainting|blacking out|blackout|blurred vision|headache|nausea|vomiting|fever|sweating|chills|cough|wheezing|itching|rash|chest pain|back pain|neck pain|knee pain|leg pain|abdominal pain|stomach pain|joint pain|muscle ache|sore throat",
    "CONDITION": "hypertension|high blood pressure|low blood pressure|diabetes|asthma|copd|stroke|heart attack|heart failure|afib|atrial fibrillation|angina|arrhythmia|tachycardia|bradycardia|stenosis|blockage|blocked artery|high cholesterol|sleep apnea|anxiety|depression|obesity|sciatica|arthritis|tendinitis|tendonitis|bursitis|carpal tunnel|frozen shoulder|plantar fasciitis|rotator cuff tear|meniscus tear|acl tear|fracture|sprain|strain|whiplash|slipped disc|herniated disc|pinched nerve|kidney stones|thyroid",
    "DRUG": "aspirin|paracetamol|ibuprofen|naproxen|panadol|amlodipine|losartan|valsartan|lisinopril|ramipril|atenolol|metoprolol|bisoprolol|carvedilol|atorvastatin|rosuvastatin|simvastatin|warfarin|clopidogrel|rivaroxaban|apixaban|dabigatran|metformin|insulin|salbutamol|ventolin|blood pressure medicine|bp medicine|bp meds|statin|statins|beta blocker|ace inhibitor|calcium channel blocker|diuretic|blood thinner|blood thinners|nitroglycerin|gtn|nitro spray|painkiller|painkillers|antibiotic|antibiotics",
    "PROCEDURE": "mri|ct|x-ray|xray|ultrasound|echo|echocardiogram|ecg|ekg|holter|stress test|blood test|bloods|angiogram|angioplasty|stent|bypass|cabg|ablation|pacemaker|physio session|physiotherapy session|physical therapy|rehab session|scan|imaging|biopsy|surgery|operation|exercise programme|exercise program|home exercises|stretching exercises|cardio rehab|cardiac rehab",
    "TIME": "morning|afternoon|evening|night|noon|today|tomorrow|yesterday|weekly|daily|monthly|yearly|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|now|soon|later|before|after",
    "PERSON": "kid|kids|child|children|baby|infant|mother|father|parent|parents|wife|husband|son|daughter|elderly|senior|pregnant|pregnancy|diabetic|diabetics|hypertensive",
}

# Parts of speech; later lists win.
POS = [
    ("DT", "a an the this that these those my your his her its our their some any every each no another"),
    ("PRP", "i you he she it we they me him her us them myself yourself himself herself ourselves themselves"),
    ("IN", "in on at of for with by from to into onto after before during under over between around near through without within about than while since until because if unless though although as"),
    ("CC", "and or but nor so yet"),
    ("MD", "can could will would shall should may might must ought"),
    ("WH", "what why how when where who which whom whose"),
    ("UH", "hi hello hey yo oh ah wow ouch ok okay yes no yeah nope thanks thank"),
    ("JJ", "good bad high low safe unsafe normal abnormal severe mild moderate sharp dull constant intermittent sudden chronic acute tired sore stiff swollen dizzy weak painful comfortable uncomfortable regular irregular fast slow early late young old new able unable necessary dangerous important urgent right wrong left okay fine"),
    ("VB", "is are was were be been being am have has had do does did feel felt feeling take took taking taken go went gone going come came coming see saw seen want wanted wanting need needed needing tell told telling ask asked asking give gave given giving make made making happen happens happened occur occurs occurred stop stopped stopping start started starting help helped helping exercise exercising eat ate eating drink drank drinking sleep slept sleeping feels treat treated treating cure cured curing diagnose diagnosed diagnosing hurt hurts hurting ache aches aching swell swelled swelling bleed bled bleeding"),
    ("RB", "not n't never always often sometimes usually rarely very really quite too also only even just well badly fast slowly soon later earlier still yet already today yesterday tomorrow now then"),
]

# Irregular forms.
IRREGULAR_NOUNS = dict(p.split(":") for p in "feet:foot teeth:tooth men:man women:woman children:child people:person mice:mouse geese:goose lice:louse vertebrae:vertebra bacteria:bacterium criteria:criterion phenomena:phenomenon diagnoses:diagnosis prognoses:prognosis stenoses:stenosis fungi:fungus nuclei:nucleus stimuli:stimulus indices:index matrices:matrix appendices:appendix vertices:vertex analyses:analysis axes:axis crises:crisis theses:thesis neuroses:neurosis".split())
IRREGULAR_VERBS = dict(p.split(":") for p in "is:be are:be was:be were:be been:be being:be am:be has:have had:have having:have does:do did:do done:do doing:do went:go gone:go going:go took:take taken:take taking:take ran:run running:run ate:eat eaten:eat eating:eat saw:see seen:see seeing:see felt:feel feeling:feel thought:think thinking:think got:get gotten:get getting:get made:make making:make broken:break broke:break breaking:break fell:fall fallen:fall falling:fall lost:lose losing:lose began:begin begun:begin beginning:begin spoke:speak spoken:speak speaking:speak hurt:hurt hurting:hurt ached:ache aching:ache swelled:swell swollen:swell swelling:swell bled:bleed bleeding:bleed".split())
IRREGULAR_ADJECTIVES = dict(p.split(":") for p in "better:good best:good worse:bad worst:bad more:many most:many less:little least:little older:old oldest:old younger:young youngest:young easier:easy easiest:easy".split())
