"""Seed texts of the languages that share the Latin script, and a little Hindi and Urdu. Written for this project.

They only start the language dictionaries, which then grow from labelled rows that the seeds agree with.
"""

from __future__ import annotations

SEEDS: dict[str, str] = {
    "en": """
what is the best way to treat this pain and how long will it take before i feel better. why do i get a headache when i stand up.
can i take the tablets with food or should i wait until the morning. i have been feeling tired since last week and my back hurts.
please tell me what to do before the appointment and whether i need to bring anything with me. is it safe to drive after the scan.
the doctor said that it would be fine but i am still worried about the results. should i go to the hospital if it gets worse.
thank you so much for your help, that was very useful. you should call the emergency number if you have trouble breathing.
most patients recover within a few weeks, although some of them need more time. it does not hurt, and you can go home the same day.
how often should this exercise be done and when can i start running again. do not stop the medicine without asking your doctor first.
my mother is really worried because of all this and she does not know what we are supposed to do now. i already told the nurse yesterday.
there is nothing to be afraid of, but let us know if you are pregnant. this is not the first time that i have told you about it.
we will send the letter to your home address and ring you tomorrow. which tests show whether the heart is working as it should.
could you help me with the booking because i cannot find the page any more. what exactly does it mean when they say that it is normal.
avoid salty food, drink plenty of water and walk every day. keep your leg up at night and put some ice on it for ten minutes.
does this bot know who i am and can it read my letters. where should we park the car and on which floor is the ward.
the machine is loud but harmless; you will hear a knocking sound. if there is any swelling around the knee, tell us about it at once.
everything looks fine according to her report, he says, and nothing else was found. something about this question is still not clear to anyone.
actually i never really thought about it like that, but perhaps someone else has already seen those papers and can say more.
honestly i have no idea, sorry for asking again. the people at the front desk were very kind to me and my father.
""",
    "de": """
was soll ich gegen die Schmerzen tun und wie lange dauert es, bis es mir besser geht. warum habe ich Kopfschmerzen, wenn ich aufstehe.
kann ich die Tabletten mit dem Essen nehmen oder muss ich bis morgen früh warten. ich bin seit letzter Woche müde und mein Rücken tut weh.
bitte sagen Sie mir, was ich vor dem Termin machen soll und ob ich etwas mitbringen muss. darf ich nach der Untersuchung Auto fahren.
der Arzt hat gesagt, dass alles in Ordnung ist, aber ich mache mir trotzdem Sorgen. soll ich ins Krankenhaus gehen, wenn es schlimmer wird.
vielen Dank für Ihre Hilfe, das war sehr nützlich. rufen Sie den Notruf an, wenn Sie schlecht Luft bekommen.
die meisten Patienten erholen sich innerhalb weniger Wochen, manche brauchen aber mehr Zeit. es tut nicht weh und Sie können am selben Tag nach Hause.
wie oft soll man diese Übung machen und wann darf ich wieder laufen. setzen Sie das Medikament nicht ab, ohne vorher zu fragen.
meine Mutter macht sich deswegen große Sorgen und ich weiß wirklich nicht, was wir jetzt machen sollen. ich habe es der Schwester gestern schon erzählt.
wir schicken den Brief an Ihre Adresse und melden uns morgen bei Ihnen. welche Untersuchung zeigt, ob das Herz richtig arbeitet.
können Sie mir bei der Anmeldung helfen, weil ich die Seite nicht mehr finde. was heißt das genau, wenn man sagt, dass es normal ist.
vermeiden Sie salziges Essen, trinken Sie viel Wasser und gehen Sie jeden Tag spazieren. legen Sie nachts das Bein hoch und kühlen Sie es zehn Minuten.
wo kann man hier parken und in welchem Stock liegt die Station. mein Name ist und ich wohne in der Straße neben dem Park.
das Gerät ist laut, aber harmlos; Sie hören ein Klopfen. wenn das Knie geschwollen ist, sagen Sie uns sofort Bescheid.
laut dem Bericht ist alles in Ordnung, sagt er, und sonst wurde nichts gefunden. etwas an dieser Frage ist noch niemandem klar.
eigentlich habe ich keine Ahnung, entschuldigen Sie, dass ich noch einmal frage. die Leute am Empfang waren sehr freundlich zu mir und meinem Vater.
""",
    "fr": """
que dois-je faire contre la douleur et combien de temps faut-il avant que je me sente mieux. pourquoi ai-je mal à la tête quand je me lève.
est-ce que je peux prendre les comprimés avec le repas ou dois-je attendre le matin. je suis fatigué depuis la semaine dernière et j'ai mal au dos.
dites-moi s'il vous plaît ce qu'il faut faire avant le rendez-vous et si je dois apporter quelque chose. puis-je conduire après l'examen.
le médecin a dit que tout allait bien mais je suis encore inquiet pour les résultats. dois-je aller à l'hôpital si cela empire.
merci beaucoup pour votre aide, c'était très utile. appelez les urgences si vous avez du mal à respirer.
la plupart des patients se remettent en quelques semaines, mais certains ont besoin de plus de temps. ce n'est pas douloureux et vous rentrez chez vous le jour même.
à quelle fréquence faut-il faire cet exercice et quand pourrai-je recommencer à courir. n'arrêtez pas le traitement sans demander à votre médecin.
ma mère est très inquiète à cause de cela et je ne sais vraiment pas ce que nous devons faire maintenant. je l'ai déjà dit à l'infirmière hier.
nous enverrons la lettre à votre adresse et nous vous appellerons demain. quels examens montrent si le cœur fonctionne bien.
pouvez-vous m'aider pour la réservation parce que je ne trouve plus la page. qu'est-ce que cela veut dire exactement quand on dit que c'est normal.
évitez les aliments salés, buvez beaucoup d'eau et marchez tous les jours. gardez la jambe levée la nuit et mettez de la glace pendant dix minutes.
où peut-on garer la voiture et à quel étage se trouve le service. je m'appelle et j'habite dans la rue près du parc, mon numéro est le suivant.
l'appareil est bruyant mais sans danger ; vous entendrez des coups. si le genou est enflé, prévenez-nous tout de suite.
d'après le rapport tout va bien, dit-il, et rien d'autre n'a été trouvé. quelque chose dans cette question n'est encore clair pour personne.
franchement je n'en ai aucune idée, désolé de poser encore la question. les gens à l'accueil ont été très gentils avec mon père et moi.
""",
    "es": """
qué debo hacer para el dolor y cuánto tiempo tardaré en sentirme mejor. por qué me duele la cabeza cuando me levanto.
puedo tomar las pastillas con la comida o tengo que esperar hasta la mañana. estoy cansado desde la semana pasada y me duele la espalda.
por favor dígame qué tengo que hacer antes de la cita y si debo llevar algo. puedo conducir después de la prueba.
el médico dijo que todo estaba bien pero todavía estoy preocupado por los resultados. debo ir al hospital si empeora.
muchas gracias por su ayuda, ha sido muy útil. llame a urgencias si le cuesta respirar.
la mayoría de los pacientes se recupera en pocas semanas, aunque algunos necesitan más tiempo. no duele y puede volver a casa el mismo día.
con qué frecuencia hay que hacer este ejercicio y cuándo podré correr otra vez. no deje el medicamento sin hablar con su médico.
mi madre está muy preocupada por todo esto y la verdad es que no sé qué tenemos que hacer ahora. ya se lo dije ayer a la enfermera.
enviaremos la carta a su dirección y le llamaremos mañana. qué pruebas muestran si el corazón funciona bien.
me puede ayudar con la reserva porque ya no encuentro la página. qué significa exactamente cuando dicen que es normal.
evite la comida salada, beba mucha agua y camine todos los días. mantenga la pierna en alto por la noche y ponga hielo durante diez minutos.
dónde se puede aparcar el coche y en qué planta está la sala. me llamo y vivo en la calle junto al parque, mi teléfono es el siguiente.
el aparato hace ruido pero no es peligroso; oirá unos golpes. si la rodilla está hinchada, avísenos enseguida.
según el informe todo está bien, dice él, y no se encontró nada más. algo de esta pregunta todavía no está claro para nadie.
sinceramente no tengo ni idea, perdone que pregunte otra vez. la gente de la recepción fue muy amable conmigo y con mi padre.
""",
    "ur-latn": """
mujhe dard ke liye kya karna chahiye aur kitne din mein theek ho jaoon ga. jab main uthta hoon to sar mein dard kyun hota hai.
kya main goli khane ke saath le sakta hoon ya subah tak intezar karoon. pichle hafte se main thaka hua hoon aur meri kamar mein dard hai.
meherbani kar ke batayen ke appointment se pehle kya karna hai aur kya saath lana hai. kya scan ke baad gaari chala sakte hain.
doctor ne kaha tha ke sab theek hai lekin mujhe ab bhi fikar hai. agar takleef barh jaye to kya hospital jaoon.
bohat shukriya aap ki madad ka, yeh bohat kaam aaya. saans phoole to foran phone karein.
zyada tar mareez chand hafton mein theek ho jate hain magar kuch ko zyada waqt lagta hai. dard nahi hota aur aap usi din ghar ja sakte hain.
yeh warzish kitni dafa karni hai aur main dobara kab bhaag sakta hoon. apni marzi se dawai band na karein.
meri walida is baat se bohat pareshan hain aur mujhe samajh nahi aa raha ke ab hum kya karein. maine kal nurse ko bata diya tha.
hum khat aap ke ghar ke pate par bhej denge aur kal phone karenge. kis test se pata chalta hai ke dil theek kaam kar raha hai.
mujhe booking mein madad chahiye kyunke mujhe safha nahi mil raha. is ka kya matlab hai jab woh kehte hain ke yeh mamool ki baat hai.
namak kam khayen, pani zyada piyen aur rozana chehal qadmi karein. raat ko tang oonchi rakhein aur das minute baraf lagayen.
gaari kahan khari karni hai aur ward kis manzil par hai. mera naam yeh hai aur mera number yeh hai, mera pata gali ke paas hai.
machine shor karti hai magar khatarnak nahi hai. agar ghutne mein soojan ho to hamein foran batayen.
report ke mutabiq sab theek hai, woh kehta hai, aur kuch nahi mila. is sawal ki koi baat ab tak kisi ko samajh nahi aayi. agar ho sake to jaldi jawab de dein.
sach poochein to mujhe kuch pata nahi, dobara poochne ki maafi chahta hoon. log mere aur mere walid ke saath bohat ache the.
""",
    "hi": """
मुझे दर्द के लिए क्या करना चाहिए और कितने दिन में ठीक हो जाऊँगा। जब मैं उठता हूँ तो सिर में दर्द क्यों होता है।
मेरी माँ इस बात से बहुत परेशान हैं और मुझे समझ नहीं आ रहा कि अब क्या करना चाहिए। डॉक्टर ने कहा था कि सब ठीक है।
""",
    "ur": """
مجھے درد کے لیے کیا کرنا چاہیے اور کتنے دن میں ٹھیک ہو جاؤں گا۔ جب میں اٹھتا ہوں تو سر میں درد کیوں ہوتا ہے۔
میری والدہ اس بات سے بہت پریشان ہیں اور مجھے سمجھ نہیں آ رہا کہ اب کیا کرنا چاہیے۔ ڈاکٹر نے کہا تھا کہ سب ٹھیک ہے۔
""",
}
