"""Word lists, pattern tables and thresholds. Results depend on each of them."""

# Payload categories, each a list of (weight, pattern), matched without case.
PAYLOAD = {
    "payment_change": [
        (0.75, r"\bchang(e|ing)\s+(?:the\s+)?(?:bank|banking|routing|account|payment)\b"),
        (0.75, r"\bupdat(e|ing|ed)\s+(?:the\s+)?(?:bank|banking|routing|account|payment|vendor\s+payment|ach)\b"),
        (0.75, r"\bnew\s+(?:bank|banking|routing|account|payment|vendor\s+payment|ach)\b"),
        (0.7, r"\brouting\s+number\b"),
        (0.6, r"\bach\s+(?:details|info|information|instructions|transfer|payment)\b"),
        (0.65, r"\biban\b|\bswift\s+code\b"),
        (0.7, r"\b(?:updated|new|revised)\s+(?:payment|wiring|banking)\s+(?:details|info|instructions)\b"),
    ],
    "gift_cards": [
        (0.85, r"\bgift\s+cards?\b"),
        (0.8, r"\bitunes\s+(?:card|gift)\b"),
        (0.8, r"\bamazon\s+(?:card|gift\s+card)\b"),
        (0.8, r"\bsteam\s+card\b|\bgoogle\s+play\s+card\b"),
        (0.85, r"\bbuy\s+(?:\$?\d+\s+(?:in|worth\s+of)\s+)?(?:gift|itunes|amazon)\b"),
    ],
    "wire": [
        (0.55, r"\bwire\s+(?:transfer|payment|the\s+funds)\b"),
        (0.55, r"\bprocess\s+(?:a\s+)?wire\b"),
        (0.5, r"\btransfer\s+(?:\$?\d|funds|the\s+money)\b"),
        (0.5, r"\bsend\s+(?:the\s+)?(?:money|funds|payment)\b"),
    ],
    "credentials": [
        (0.8, r"\b(?:send|share|forward)\s+(?:me\s+)?(?:your\s+|the\s+)?password\b"),
        (0.75, r"\breset\s+(?:your|the|my)\s+password\b"),
        (0.75, r"\bverify\s+(?:your|the)\s+(?:account|credentials|login)\b"),
        (0.75, r"\bmfa\s+(?:code|token)\b"),
        (0.75, r"\b(?:2fa|two[-\s]factor)\s+code\b"),
        (0.7, r"\b(?:update|confirm)\s+(?:your\s+)?credentials\b"),
    ],
    "sensitive_data": [
        (0.7, r"\b(?:team|employee|staff)\s+roster\b"),
        (0.7, r"\bemployee\s+(?:list|directory|details)\b"),
        (0.8, r"\bw[-\s]?2\b|\bw2s?\b"),
        (0.8, r"\bsocial\s+security\s+number\b|\bssn\b"),
        (0.65, r"\btax\s+(?:info|information|forms|returns)\b"),
        (0.6, r"\b(?:send|forward|share)\s+(?:the\s+)?(?:q\d|quarterly|annual)?\s*financials?\b"),
        (0.55, r"\bpayroll\b"),
    ],
    "crypto": [
        (0.8, r"\bbitcoin\b"),
        (0.8, r"\bbtc\s+(?:wallet|address|payment|transfer)\b"),
        (0.8, r"\busdt\b|\busdc\b|\bethereum\b|\beth\s+wallet\b"),
        (0.85, r"\bcrypto\s+(?:wallet|address)\b"),
    ],
    "financial_urgency": [
        (0.55, r"\b(?:approve|pay|process)\s+(?:the\s+|this\s+)?invoice\b"),
        (0.5, r"\bpayment\s+(?:today|eod|by\s+(?:end\s+of\s+day|friday|cob))\b"),
        (0.5, r"\bfinancial\s+(?:approval|authorization)\b"),
    ],
    "urgency": [
        (0.2, r"\b(?:urgent|urgently|asap)\b"),
        (0.15, r"\bbefore\s+(?:eod|end\s+of\s+day|cob|cob\s+today|close\s+of\s+business)\b"),
        (0.15, r"\bimmediately\b"),
        (0.15, r"\bright\s+(?:now|away)\b"),
    ],
    "secrecy": [
        (0.2, r"\bdon'?t\s+discuss\b|\bkeep\s+(?:this\s+)?(?:quiet|confidential|between\s+us)\b"),
        (0.2, r"\bconfidential(?:ly)?\b"),
        (0.15, r"\bdo\s+not\s+tell\b|\bdo\s+not\s+mention\b"),
        (0.2, r"\bon\s+a\s+flight\b|\bin\s+a\s+meeting\b|\bon\s+my\s+phone\b"),
    ],
}
SOFT = ("urgency", "secrecy")
SOFT_AMPLIFIER = 0.15

# Sensitive-data patterns (name, pattern, group of the value, base confidence, context words or None, tags).
SENSITIVE = [
    ("credit_card", r"\b(?:4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|3[47]\d{1}[\s\-]?\d{6}[\s\-]?\d{5}|6(?:011|5\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b", 0, 3, None, ("PCI-DSS",)),
    ("ssn", r"\b(?!000|666|9\d{2})\d{3}[\s\-]\d{2}[\s\-]\d{4}\b", 0, 2, r"(?i)(?:ssn|social\s*security|ss#|soc\s*sec)", ("PII", "State Breach Notification")),
    ("routing_number", r"\b[0-3]\d{8}\b", 0, 2, r"(?i)(?:routing|aba|bank|transit|wire)", ("Financial Data", "PII")),
    ("iban", r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}(?:[\s]?[\dA-Z]{1,4}){0,5}\b", 0, 3, None, ("Financial Data", "GDPR", "PII")),
    ("api_key_aws", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0, 3, None, ("Credentials", "Security")),
    ("api_key_stripe", r"\b(?:sk_live|pk_live|sk_test|pk_test)_[A-Za-z0-9]{24,}\b", 0, 3, None, ("Credentials", "PCI-DSS", "Security")),
    ("api_key_github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", 0, 3, None, ("Credentials", "Security")),
    ("api_key_generic", r"""(?i)(?:api[_\-]?key|apikey|secret[_\-]?key|access[_\-]?token|auth[_\-]?token)[\s:=]+["']?([A-Za-z0-9\-_]{32,})["']?""", 1, 2, None, ("Credentials", "Security")),
    ("private_key", r"-----BEGIN\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----[\s\S]{20,}-----END\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----", 0, 3, None, ("Credentials", "Security")),
    ("us_passport", r"\b[A-Z]\d{8}\b", 0, 1, r"(?i)(?:passport|travel\s*doc)", ("PII", "GDPR")),
    ("medical_record", r"(?i)(?:MRN|medical\s*record|patient\s*id|health\s*id)[\s:#]*(\d{6,12})", 1, 2, None, ("HIPAA", "PHI")),
]
# Contexts within 50 characters of a match's start that void it.
FALSE_POSITIVE = {
    "credit_card": r"(?:invoice|order|po|ref|tracking|ticket|confirmation)[\s#:]*\d{13,19}",
    "ssn": r"(?:phone|tel|fax|ext|zip|postal)[\s:]*\d{3}[\s\-]\d{2}[\s\-]\d{4}",
    "routing_number": r"(?:zip|postal|phone|ext)[\s:]*\d{9}",
}
CONFIDENCE = ("none", "low", "medium", "high")

# The 150 function words of the style vector, in its order.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "a", "in", "that", "is", "was", "it", "for", "on", "with", "as", "be", "by", "at", "this",
    "have", "from", "or", "had", "but", "not", "are", "they", "we", "you", "your", "i", "me", "my", "mine", "our",
    "ours", "he", "him", "his", "she", "her", "hers", "them", "their", "theirs", "who", "whom", "whose", "which", "what",
    "where", "when", "why", "how", "would", "could", "should", "will", "shall", "may", "might", "must", "can", "do",
    "does", "did", "done", "doing", "has", "having", "been", "being", "if", "then", "else", "than", "so", "because",
    "while", "although", "though", "after", "before", "during", "since", "until", "unless", "whereas", "yet", "about",
    "above", "across", "against", "along", "among", "around", "behind", "below", "beneath", "beside", "between",
    "beyond", "despite", "down", "into", "near", "off", "onto", "out", "over", "through", "throughout", "toward",
    "under", "up", "upon", "via", "within", "without", "just", "only", "also", "too", "very", "quite", "rather", "still",
    "already", "again", "always", "never", "often", "sometimes", "usually", "here", "there", "now", "today", "tomorrow",
    "yesterday", "soon", "later", "once", "twice", "both", "either", "neither", "each", "every", "any", "some",
]
assert len(FUNCTION_WORDS) == 150

# Signs of bulk or automated mail, looked for in subject and body in lower case.
BULK = [
    "unsubscribe", "auto-reply", "out of office", "automatic reply", "do not reply", "noreply", "newsletter", "invitation:", "accepted:",
    "declined:", "tentative:", "canceled:", "updated invitation",
]
# Marks at which a reply chain is cut, of exported mail and of mail pulled for a tenant.
REPLY_CUTS = [r"\nOn .+wrote:\s*\n", r"\n-{3,}\s*Original Message\s*-{3,}", r"\nFrom:\s+.+\n", r"\n>{1,}\s"]
TENANT_REPLY_CUTS = [r"\nOn .+wrote:\s*\n", r"\n-{3,}\s*Original Message\s*-{3,}", r"\n-{3,}\s*Forwarded\s", r"\nFrom:\s+.+\nSent:\s+"]
# Marks at which a signature is cut, beyond 30 % of what is left; the owner's name is a parameter.
SIGNATURE_CUTS = [
    r"\n--\s*\n", r"\nSent from my ", r"\nGet Outlook for ", r"\n_{3,}", r"\nBest regards,?\s*\n", r"\nRegards,?\s*\n", r"\nThanks,?\s*\n",
    r"\nThank you,?\s*\n", r"\nCheers,?\s*\n",
]
TENANT_SIGNATURE_CUTS = [r"\n--\s*\n", r"\n---\s*[A-Z]", r"\nSent from my (?:iPhone|iPad|Android)", r"\nGet Outlook for "]
# Words that signatures are made of.
SIGNATURE_WORDS = ["founder", "partner", "managing", "ceo", "cto", "director", "president", "manager", "consultant", "principal", "owner", "chief", "vp", "vice", "sent", "mailto", "http", "https", "www", "com"]
SIGNATURE_TITLES = ["founder", "partner", "ceo", "cto", "director", "manager", "president", "vp ", "vice president", "consultant", "managing", "principal", "owner", "chief"]
# Openers and closers that the scorer of a single message knows.
MESSAGE_GREETINGS = ["hi", "hey", "hello", "good", "dear", "hope", "howdy", "greetings"]
MESSAGE_CLOSINGS = ["thanks", "thank", "best", "regards", "cheers", "sincerely", "take care", "talk soon"]

# Lines that end the body in the style vector's cleaning.
FOOTERS = [
    r"--\s*$", r"---+\s*\w*\s*$", r"_{5,}\s*$", r"-{5,}\s*$", r"={5,}\s*$", r"\*{5,}\s*$", r"-+\s*Original Message\s*-+", r"-+\s*Forwarded message\s*-+",
    r"On\s.+(wrote|sent|said):\s*$", r"Sent from my\s", r"Sent from Outlook\b", r"Sent via\s", r"Get Outlook for\s", r"Download Outlook\b",
    r"CONFIDENTIAL(ITY)?\b", r"DISCLAIMER\b", r"PRIVILEGED\b", r"LEGAL\s*NOTICE\b", r"IMPORTANT\s*(LEGAL\s*)?NOTICE\b", r"NOTICE:\s*This\b",
    r"This (e-?mail|message|communication|transmission)", r"The information (contained |transmitted )?in this\b", r"If you (are|have) (not )?(the intended|received)",
    r"Please (consider the environment|do not print)", r"P\.?\s*Please consider the environment", r"Any unauthorized (review|use|disclosure)", r"Securities (offered|products)", r"HIPAA\b",
]

# Phrase lexicons of the profile. True: counted as whole words.
TRANSITIONS = ["however", "that said", "having said that", "on the other hand", "at the same time", "with that in mind", "that being said", "on another note", "in any case", "either way", "bottom line", "at the end of the day", "long story short", "the thing is", "here's the thing", "the reality is", "to be clear", "to be fair", "to be honest", "for what it's worth", "in other words", "on a separate note", "one more thing", "also worth noting", "meanwhile", "in the meantime", "as a result", "furthermore", "moreover", "additionally", "alternatively"]
INTENSIFIERS = ["really", "very", "extremely", "incredibly", "absolutely", "definitely", "certainly", "completely", "totally", "particularly", "especially", "significantly", "truly", "deeply", "highly", "strongly", "super", "tremendous", "phenomenal", "outstanding"]
SOFTENERS = ["maybe", "perhaps", "possibly", "might", "could", "sort of", "kind of", "a bit", "a little", "somewhat", "i think", "i believe", "i feel", "i guess", "i suppose", "it seems", "apparently", "not sure if", "i wonder", "would it be possible", "if possible", "if you could", "no worries if", "no pressure", "when you get a chance", "at your convenience", "feel free to"]
ACTIONS = ["can you", "could you", "would you", "will you", "please", "i need", "we need", "would you mind", "if you could", "go ahead and", "feel free to", "make sure", "i'd appreciate", "let's", "how about", "what if we", "i suggest", "i recommend", "next steps"]
AGREEMENT = ["i agree", "agreed", "absolutely", "exactly", "makes sense", "for sure", "love it", "perfect", "works for me", "sounds good", "sounds great"]
DISAGREEMENT = ["i don't think", "i'm not sure", "my concern is", "the issue is", "the problem is", "the challenge is", "that said", "to be fair", "on the flip side", "not quite", "hold on"]
TEMPORAL = ["asap", "as soon as possible", "right away", "immediately", "at your convenience", "when you get a chance", "no rush", "take your time", "by end of day", "this week", "next week", "moving forward", "going forward", "urgent", "priority"]
LEXICON = [(kind, phrase, kind == "intensifier", least) for kind, least, phrases in (("transition", 2, TRANSITIONS), ("intensifier", 2, INTENSIFIERS), ("softener", 2, SOFTENERS), ("action", 2, ACTIONS), ("agreement", 1, AGREEMENT), ("disagreement", 1, DISAGREEMENT), ("temporal", 1, TEMPORAL)) for phrase in phrases]

# Openers, closers, phrases that say nothing, and words no template starts with.
GREETING_WORDS = ("hi", "hey", "hello", "good", "dear", "hope", "howdy", "yo", "greetings")
CLOSING_WORDS = ("thanks", "thank", "best", "regards", "cheers", "sincerely", "take care", "talk soon", "chat soon", "looking forward", "let me know", "have a", "all the best", "warm", "kind", "respectfully", "appreciate", "grateful", "speak soon")
NOISE_PHRASES = ("i think", "i have", "i am", "i was", "i will", "i can", "it is", "it was", "there is", "there are", "this is", "that is", "we have", "we are", "we will", "we can", "do you", "can you", "will you", "would you", "could you", "let me know", "thank you", "thanks for", "sounds good", "as well", "in the", "of the", "for the", "on the", "to the", "at the", "by the", "with the", "from the", "and the", "but the", "is the", "are the", "was the", "have a", "has been", "have been", "had been", "going to", "want to", "need to", "able to", "a lot", "a few", "a bit", "right now")
SKIP_STARTERS = ("the", "a", "an", "in", "on", "at", "to", "for", "of", "by", "it", "this", "that")
CONTRACTION = r"""(?i)\b[a-z]+n['’]t\b|\b[a-z]+['’](?:ve|re|ll|d|s|m)\b"""
EXPANDED = r"(?i)\b(?:do not|does not|did not|will not|would not|could not|should not|cannot|is not|are not|was not|were not|have not|has not|i am|i have|i will|we are|we have|they are)\b"
