"""Word lists and patterns that results depend on."""

# Words that a gloss match skips. Fixed values.
FUNCTION_WORDS = """a an and any anybody anyone anything are as at be become being between but by each either every for from have
having he her hers him his i in into is it its itself me my neither not of on one ones only or other our ours own same she some
somebody someone something such that the their them themselves there these this those to we what when where which who whom whose
with you your yours""".split()
GLOSS_GLUE = "another especially including kind made mainly manner often particular relating respectively similar sometimes sort typically use used using usually".split()
TAXONOMIC_GLUE = "action class family genus grouping kind member members order people person process species state subspecies type way".split()
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
STOPWORDS = sorted({*FUNCTION_WORDS, *GLOSS_GLUE, *TAXONOMIC_GLUE, *NUMBER_WORDS})

# A token: ASCII letters with at most one inner apostrophe. Fixed value.
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
