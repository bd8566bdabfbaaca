"""Sentences written by hand, apart from any generated table: what a reader would and would not call abusive."""

ABUSIVE = [
    "kill all the jews", "faggot", "you faggots make me sick", "he raped her", "you are a n1gger", "kys", "you people are animals", "you are a basterd",
    "I swear I'm gonna stab you", "someone should shoot you in the head", "I hope you die in a car crash", "I know where you live, watch your back",
    "We'll burn down your house with you in it", "you deserve to get beaten", "go hang yourself", "If you show up again I'll smash your skull", "I will strangle you with your own headphones cable",
    "You are such a pathetic excuse for a human", "shut your mouth you stupid cow", "what a bunch of retards", "Your brother is a worthless scumbag", "he's a complete wanker", "Go fuck yourself", "fuck off you twat",
    "you're dumb", "Nobody likes you, creep", "Idiot!", "You absolute moronn", "you are an imbicile", "ur such a l0ser", "stupid b*tch", "the new bass player is a filthy whore",
    "Muslims are all terrorists and should be deported", "gays are disgusting", "women are too dumb to produce music", "immigrants are parasites", "I hate jews", "black people are subhuman", "Go back to your country", "Foreigners should be thrown out", "we must get rid of the gypsies", "Their religion is a disease", "That religion breeds animals", "no believer should be allowed to sing", "Mexicans are lazy criminals",
    "I want to fuck you so hard", "send me pics of your tits", "she sucked his cock", "show me your pussy", "I'd love to lick your nipples", "he came all over her face", "wanna see you naked", "I am so horny right now",
    "Du bist ein Arschloch", "Halt die Klappe, du dumme Schlampe", "Ich bringe dich um", "Alle Ausländer sind Verbrecher", "Verpiss dich, du Hurensohn",
    "Tu es un connard", "Ferme ta gueule", "Je vais te tuer", "Les arabes sont des parasites", "Va te faire foutre, sale pute",
    "Eres un imbécil", "Te voy a matar", "Vete a la mierda, hijo de puta", "Los judíos son una plaga",
    "Sei uno stronzo", "Ti ammazzo", "Vaffanculo, coglione", "Você é um idiota", "Vou te matar, seu otário", "Vai se foder",
    "είσαι μαλάκας", "Είσαι ηλίθιος", "お前は馬鹿か", "死ね", "このクソ野郎",
]
HARMLESS = [
    "cut you some slack", "this track kills you softly", "the bass will kill you", "thrust into the spotlight", "I would hang you a picture",
    "That solo absolutely kills", "killer riff, I'm dying to hear more", "The drop hits you in the face", "I'll shoot you an email tomorrow", "the compressor is choking the mix", "we need to kill the hum at 50 Hz", "you could cut the reverb by half", "Don't beat yourself up about the timing", "the groove just runs away with you", "I had to murder the high end", "hit me up when you have the stems", "slap bass with a punchy kick", "Break the song into stems", "I will kick off the session at nine", "you can push the fader a bit", "Let me know if you need a hand with the strings", "this song will make you cry",
    "This mix is stupidly loud", "what a shit mix", "the vocal sounds like garbage", "that plugin is a bitch to set up", "I felt like an idiot after the session", "I'm such a moron, I recorded in mono", "my dumb ears missed the panning", "fuck, I love this bridge", "damn that is a filthy bass line", "dirty guitars and ugly distortion, exactly my taste", "the snare is worthless in this take", "holy shit that chorus",
    "The moderator removed a message that called a member a moron", "Using words like retard or whore gets you banned", "The word faggot was bleeped in the radio edit", "She reported the message \"you should die\" to the team", "the study examines threats such as \"I will kill you\" in comments", "He was called an idiot for liking mono",
    "Women rated the mixes higher on average", "Deaf people feel the bass through the floor", "Immigrants were interviewed about their listening habits", "Jewish music has a long history", "Muslims and Jews sang together", "gay couples danced to the remix", "Old people are not inferior listeners", "Refugees should not be sent back", "Foreigners should never be excluded from a study", "No believer should be left out of the choir", "That faith in analogue gear is stupid", "That kind of reverb is dirty", "Their culture is beautiful", "Black musicians invented this genre",
    "a naked vocal without reverb", "strip the arrangement down to bass and drums", "ride the fader in the chorus", "the cock crowed in the intro sample", "hard panned guitars", "she kissed the microphone by accident", "he came back after the break", "touch up the vocals", "the tape sucks the life out of the highs", "her hand slid along the fretboard",
    "Die Mischung ist dumm komprimiert", "Das Schlagzeug schlägt mich um", "Ich finde den Bass zu laut", "Le mixage est nul", "La caisse claire frappe fort", "La voz suena sucia", "El bajo golpea fuerte", "La batteria picchia forte", "A bateria bate forte", "το μπάσο είναι δυνατό", "このミックスは馬鹿みたいに良い",
    "pitch correction on the count-in", "where is the whole shore recording", "the batch of fader moves", "I loose the hi-hat in the verse", "an idiom of the genre", "a bold folk fuse of styles",
]
