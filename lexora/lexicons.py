"""Fixed word lists of the feature definitions, and how a list is normalised."""

from __future__ import annotations

import re
import unicodedata

# The pronoun and topic word lists that the features are defined by.

FIRST_PERSON_SINGULAR = """
אני אותי לי שלי בי ממני אלי עלי אצלי בשבילי
""".split()

FIRST_PERSON_PLURAL = """
אנחנו אותנו לנו שלנו בנו מאיתנו עלינו אלינו אצלנו
""".split()

SECOND_PERSON = """
אתה את אתם אתן אותך לך לכם לכן שלך שלכם שלכן בך בכם בכן אליך אלייך עליך עלייך
""".split()

THIRD_PERSON = """
הוא היא הם הן אותו אותה אותם אותן שלו שלה שלהם שלהן לו לה להם להן אליו אליה עליו עליה
""".split()

LOVE_WORDS = """
אהבה אהבתי אוהב אוהבת אוהבים אוהבות אהוב אהובה לב לבי נשיקה נשיקות חיבוק מחבק מחבקת תשוקה מותק יקירי יקירה
""".split()

ARMY_WORDS = """
חייל חיילים צבא מלחמה נשק מדים מפקד בסיס קרב חזית גיוס מילואים חטיבה גדוד רובה קסדה טנק פקודה מארב
""".split()

NATURE_WORDS = """
ים שמש ירח כוכב כוכבים רוח אדמה שדה שדות פרח פרחים גשם עץ עצים הר נהר מדבר שמים ציפור ציפורים עלה עלים יער
""".split()

RELIGION_WORDS = """
אלוהים אדוני תפילה תפילין שבת קודש קדוש מצווה מצוה רב ברכה אמונה נביא מלאך כיפה תורה מקדש
""".split()

PARTY_WORDS = """
מסיבה מסיבות רוקד רוקדת לרקוד ריקוד מועדון בירה יין וודקה שיכור שיכורה דרינק קצב דיגיי לילה שמחה
""".split()

SADNESS_WORDS = """
עצוב עצובה עצב דמעות דמעה בכי בוכה לבכות כאב כאוב שבור שבורה בדידות לבד צער אובדן חסר
""".split()

NOSTALGIA_WORDS = """
זיכרון זכרון זיכרונות זכרונות געגוע געגועים פעם עבר ילדות ישן ישנה אתמול תמול מזמן נוסטלגיה
""".split()

FAMILY_WORDS = """
אמא אבא אמי אבי אם אב אח אחות אחים אחיות ילד ילדה ילדים בן בת משפחה הורים סבא סבתא אשתי בעלי
""".split()

PLACE_WORDS = """
עיר רחוב כפר שכונה בית ארץ מדינה תל אביב ירושלים כביש כיכר תחנה נמל מדבר גליל נגב
""".split()

TIME_WORDS = """
יום לילה בוקר ערב שעה שעות דקה דקות רגע זמן עכשיו מחר אתמול תמיד כבר עוד שנה שנים חודש קיץ חורף
""".split()

MODERN_SLANG_WORDS = """
סבבה מגניב אחלה וואי יאללה בקטנה בכיף וייב סטורי פאק קול דאחקה כפרה אחי סתלבט לייק פולואו טיקטוק
""".split()

OLD_ISRAELI_WORDS = """
פלמח קומזיץ צבר חלוץ חלוצים קיבוץ קיבוצניק מולדת רעות הגשמה פרדס מעברה טרקטור התיישבות שיבולים
""".split()

COHORT_FIRST_PERSON = """
אני אנחנו לי לנו אותי אותנו שלי שלנו בי בנו אליי אלינו
""".split()

COHORT_SECOND_PERSON = """
אתה את אתם אתן לך לכם לכן אותך אתכם אתכן שלך שלכם שלכן בך בכם בכן אליך אלייך אליכם אליכן
""".split()

COHORT_THIRD_PERSON = """
הוא היא הם הן לו לה להם להן אותו אותה אותם אותן שלו שלה שלהם שלהן בו בה בהם בהן
""".split()

STOP_WORDS = """
של את על עם אני זה לא כל מה מי לי לך לו לה לנו לכם לכן להם להן הוא היא הם הן כי גם אם יש אין עוד כמו אבל רק אז
או יותר פה שם כאן ו ה ל ב מ ש כ _ הזה הזאת אלה אלו אותו אותה אותם אותן
""".split()

TOPIC_EXTRA_STOP_WORDS = """
כן שם פה עכשיו היום מחר פעם דרך זמן יום לילה לב חיים
""".split()

PRONOUNS = {"first_person_singular": FIRST_PERSON_SINGULAR, "first_person_plural": FIRST_PERSON_PLURAL, "second_person": SECOND_PERSON, "third_person": THIRD_PERSON}
TOPICS = ["love", "army", "nature", "religion", "party", "sadness", "nostalgia", "family", "place", "time", "modern_slang", "old_israeli"]
SEMANTIC = {f"{t}_words_ratio": globals()[f"{t.upper()}_WORDS"] for t in TOPICS}
COHORT_PRONOUNS = {"first_person": COHORT_FIRST_PERSON, "second_person": COHORT_SECOND_PERSON, "third_person": COHORT_THIRD_PERSON}
TOPIC_STOP_WORDS = sorted({*STOP_WORDS, *TOPIC_EXTRA_STOP_WORDS})

TOKEN = re.compile("[A-Za-zא-ת]+(?:[\"'׳״][A-Za-zא-ת]+)*")


def normalise(words: list[str]) -> list[str]:
    """A list's words as tokens of normalised text, sorted and distinct."""
    found: set[str] = set()
    for w in words:
        plain = "".join(c for c in unicodedata.normalize("NFKD", w) if unicodedata.category(c) != "Mn")
        found.update(t.lower() for t in TOKEN.findall(unicodedata.normalize("NFC", plain)))
    return sorted(found)
