"""Clauses in four languages: (text, is it toxic?). The insults are those of INSULTS."""

INSULTS = {w + " ": 7.0 for w in "idiot idiots moron trottel idioten crétin idiote idiota imbécil".split()}

CLAUSES = {
    "en": [
        ("You are an idiot.", 1), ("What a moron!", 1), ("I will kill you", 1), ("I'll kill you tomorrow.", 1), ("we will hurt them", 1), ("They should stab him, all of them", 1), ("those people are idiots", 1),
        ("You are not an idiot.", 0), ("Nobody called him an idiot.", 0), ("She said that he was a moron.", 0), ("“You moron”, he said to the mirror", 0), ("We kill time on the train.", 0), ("kill the process. Then you wait", 0),
        ("Pathology is a worthwhile subject.", 0), ("I would never hurt you.", 0), ("The report told how he was killed.", 0), ("You may shoot photographs of the old bridge in the park", 0),
    ],
    "de": [
        ("Du bist ein Trottel!", 1), ("Ich werde dich umbringen.", 1), ("Wir schlagen euch", 1), ("So ein Trottel", 1), ("Idioten seid ihr", 1),
        ("Du bist kein Trottel.", 0), ("Er sagte, du seist ein Trottel.", 0), ("Die Glocken schlagen zur vollen Stunde.", 0), ("Ich werde dich nie schlagen", 0), ("Er nannte ihn einen Trottel", 0), ("Trotz allem war es schön.", 0),
    ],
    "fr": [
        ("Tu es un crétin", 1), ("Je vais te tuer !", 1), ("Quel crétin.", 1), ("Nous allons les frapper, eux et vous", 1), ("vous êtes une idiote", 1),
        ("Tu n'es pas un crétin", 0), ("Il dit que tu es un crétin.", 0), ("Je ne vais pas te frapper", 0), ("Il faut tuer le temps.", 0), ("Elle a déclaré : rien", 0), ("Les crétacés sont anciens.", 0),
    ],
    "es": [
        ("Eres un idiota", 1), ("Voy a matarte.", 1), ("vamos a golpear a ellos", 1), ("¡Imbécil!", 1), ("Tú, idiota", 1),
        ("No eres un idiota, nunca fuiste un idiota", 0), ("Dijo que él era un imbécil.", 0), ("No voy a matarte", 0), ("matar el tiempo", 0), ("El idioma es difícil.", 0), ("nunca golpear a ellos", 0),
    ],
}
